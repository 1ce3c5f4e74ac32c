"""Word packages, pulled apart into tables of runs, paragraphs, comments and unreadable packages.

A package's parts are read event by event and what has been read is dropped, so that a task holds one paragraph besides the compressed package. Packages are read side by side, each once: the tables are selections of one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refweave.sources.staging import staged

FILES = "path string, modificationTime timestamp, length long, content binary"
#: kind is run, paragraph, comment or error.
SCANNED = (
    "path string, kind string, part string, para_idx int, run_idx int, text string, rstyle string, vert_align string, highlight string, tracked string, n_begin int, n_sep int, n_end int, instr string, fld_data string, "
    "xml_id string, note_ref string, comment_mark string, has_image boolean, author string, error string"
)
_COLUMNS = [c.split()[0] for c in SCANNED.split(", ")]
RUN = [c for c in _COLUMNS if c not in ("kind", "has_image", "author")]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ID = "{http://schemas.microsoft.com/office/word/2010/wordml}paraId"
PARTS = {"word/document.xml": "body", "word/footnotes.xml": "footnote", "word/endnotes.xml": "endnote", "word/comments.xml": "comment"}
TRACKED = ("ins", "del", "moveFrom", "moveTo")
#: Rows in a frame that a task hands over at once.
FRAME_ROWS = 5000


class _Paragraph:
    __slots__ = ("idx", "part", "style", "runs", "texts", "image", "xml_id")

    def __init__(self, idx: int, part: str, xml_id: str | None):
        self.idx, self.part, self.xml_id = idx, part, xml_id
        self.style, self.runs, self.texts, self.image = None, 0, [], False


def _part_rows(stream, part: str) -> Iterator[dict]:
    """Rows of one part. Paragraphs are numbered as they begin; those in table cells of the body have the part `table`; those in text boxes come before the paragraph around them."""
    from xml.etree import ElementTree

    open_paras: list[_Paragraph] = []
    marks: list[str] = []
    cells, begun, comment, said = 0, 0, None, []
    for event, x in ElementTree.iterparse(stream, ("start", "end")):
        tag = x.tag.removeprefix(_W)
        if event == "start":
            if tag == "p":
                open_paras.append(_Paragraph(begun, "table" if cells and part == "body" else part, x.get(_ID)))
                begun += 1
            elif tag == "tc":
                cells += 1
            elif tag in TRACKED:
                marks.append(tag)
            elif tag == "comment":
                comment, said = x, []
            continue
        here = open_paras[-1] if open_paras else None
        if tag == "tc":
            cells -= 1
        elif tag in TRACKED and marks:
            marks.pop()
        elif tag == "pStyle" and here is not None:
            here.style = x.get(f"{_W}val")
        elif tag in ("drawing", "pict") and here is not None:
            here.image = True
        elif tag in ("commentRangeStart", "commentRangeEnd") and here is not None:
            yield {"kind": "run", "part": here.part, "para_idx": here.idx, "run_idx": here.runs, "text": "", "tracked": "none", "n_begin": 0, "n_sep": 0, "n_end": 0, "comment_mark": x.get(f"{_W}id")}
            here.runs += 1
        elif tag == "r" and here is not None:
            val = lambda name: next((y.get(f"{_W}val") for y in x.iter(_W + name)), None)  # noqa: B023, E731
            of = lambda name: next((y.get(f"{_W}id") for y in x.iter(_W + name)), None)  # noqa: B023, E731
            chars = [y.get(f"{_W}fldCharType") for y in x.iter(f"{_W}fldChar")]
            text, tracked = "".join(y.text or "" for y in x if y.tag in (f"{_W}t", f"{_W}delText")), marks[-1] if marks else "none"
            yield {
                "kind": "run", "part": here.part, "para_idx": here.idx, "run_idx": here.runs, "text": text, "rstyle": val("rStyle"), "vert_align": val("vertAlign"), "highlight": val("highlight"), "tracked": tracked,
                "n_begin": chars.count("begin"), "n_sep": chars.count("separate"), "n_end": chars.count("end"), "instr": "".join(y.text or "" for y in x.iter(f"{_W}instrText")) or None, "fld_data": next((y.text for y in x.iter(f"{_W}fldData")), None),
                "note_ref": of("footnoteReference") or of("endnoteReference"), "comment_mark": of("commentReference"),
            }
            here.runs += 1
            if tracked not in ("del", "moveFrom"):
                here.texts.append(text)
            x.clear()
        elif tag == "p" and here is not None:
            open_paras.pop()
            whole = "".join(here.texts)
            said.append(whole)
            yield {"kind": "paragraph", "part": here.part, "para_idx": here.idx, "text": whole, "rstyle": here.style, "has_image": here.image, "xml_id": here.xml_id}
            x.clear()
        elif tag == "comment" and comment is not None:
            yield {"kind": "comment", "part": part, "xml_id": comment.get(f"{_W}id"), "author": comment.get(f"{_W}author"), "text": "\n".join(said)}
            comment = None
            x.clear()
        elif tag in ("tbl", "sdt", "footnote", "endnote") and not open_paras:
            x.clear()


def _package_rows(path: str, content: bytes) -> Iterator[dict]:
    import io
    import zipfile

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            held = set(z.namelist())
            for name, part in PARTS.items():
                if name in held:
                    with z.open(name) as stream:
                        for row in _part_rows(stream, part):
                            yield {"path": path} | row
    except Exception as e:  # a package that can't be read is a row of its own, not the end of the job
        yield {"path": path, "kind": "error", "error": f"{type(e).__name__}: {e}"[:300]}


def scan_packages(files: DataFrame) -> DataFrame:
    """SCANNED rows of packages; unreadable ones give a row of kind error, and what came before their fault. files: path, content; an empty table gives no rows. (Spark lists no files without a byte.)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = _package_rows(path, bytes(content or b""))
                while held := list(islice(rows, FRAME_ROWS)):
                    frame = pd.DataFrame([[r.get(c) for c in _COLUMNS] for r in held], columns=_COLUMNS, dtype=object)
                    yield frame.astype({c: "Int32" for c in ("para_idx", "run_idx", "n_begin", "n_sep", "n_end")})

    return files.select("path", "content").mapInPandas(run, SCANNED)


def package_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)


def tables_of(scanned: DataFrame) -> dict[str, DataFrame]:
    """runs, paragraphs (path, part, para_idx, style, text, has_image, xml_id), comments (path, comment_id, author, text) and quarantine (path, error) of a scan. What a package held before its fault isn't in the tables."""
    bad = scanned.where("kind = 'error'").select("path", "error")
    sound = scanned.join(bad.select("path").distinct(), "path", "left_anti")
    return {
        "runs": sound.where("kind = 'run'").select(*RUN),
        "paragraphs": sound.where("kind = 'paragraph'").select("path", "part", "para_idx", F.col("rstyle").alias("style"), "text", "has_image", "xml_id"),
        "comments": sound.where("kind = 'comment'").select("path", F.col("xml_id").alias("comment_id"), "author", "text"),
        "quarantine": bad,
    }


def read_package_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of all packages below a path. They are read once and written below the shared folder."""
    return tables_of(staged(scan_packages(package_files(spark, path)), "packages"))


def document_runs(runs: DataFrame) -> DataFrame:
    """runs of packages as the operators on field codes take them: doc_id (the path) and pos, the order in the document: body and tables, footnotes, endnotes."""
    order = Window.partitionBy("path").orderBy(F.when(F.col("part").isin("body", "table"), 0).when(F.col("part") == "footnote", 1).otherwise(2), "para_idx", "run_idx")
    return runs.where("part <> 'comment'").withColumn("pos", F.row_number().over(order)).withColumnRenamed("path", "doc_id")
