"""Shared plumbing: the folder for written tables, safe column picking, a cached exact tokenizer."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
import zipfile
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the corpus contracts define it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes in an Arrow batch, at most: documents can be long.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20

_local_root: dict[str, str] = {}
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    A temporary folder stands in only where that is unset and the driver is the only machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="tessera-")
    return _local_root[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and returns the table as read back: lineage ends there, and a lost
    executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run and whatever their search path is."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[2]
    path = f"{tempfile.mkdtemp(prefix='tessera-code-')}/tessera_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.glob("tessera/**/*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(path)  # the driver serves it to executors
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """What all operators with Python workers need: the code there, and Arrow batches bounded in rows and in bytes. The
    bounds are the same for all, so that plans can be built in any order."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_table(spark: SparkSession, rows: Iterable[dict], ddl: str) -> DataFrame:
    """A small driver-side plan (its size is bounded by a parameter) as a DataFrame, without an RDD."""
    import json

    text = json.dumps(list(rows))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl}>>")))


# --- tokenizing

_WS = r"\t-\r \x85\xa0  -     　"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[!-&(-/:-@\\[-`{-~])"
#: Where byte-level pre-tokenization always cuts. One span is a run of Latin letters before ASCII punctuation other
#: than an apostrophe, or a run of non-space, either with at most one space before it, or white space that neither takes.
BYTE_SPANS = re.compile(f" ?{_LETTERS}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: A vocabulary that drops white space: its spans are the runs of non-space, cut in the same way.
WORD_SPANS = re.compile(f"{_LETTERS}|[^{_WS}]+")
#: Marks that may compose with a letter of either case and not of the other.
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_SAFE_CUT = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
_SLICE = 1 << 18
#: A space before white space or the end.
_IN_A_ROW = re.compile(f" (?=[{_WS}]|\\Z)")
#: What Python's str.split takes for white space and the tokenizers don't.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def slices(text: str) -> Iterator[str]:
    """The text in parts of about 256 K characters that tokenize alone as they do together."""
    at = 0
    while len(text) - at > 2 * _SLICE and (m := _SAFE_CUT.search(text, at + _SLICE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


#: One pre-token of either vocabulary kind, and one that normalization can only lower-case.
_RUN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_alphabet() -> dict[int, str]:
    """The characters by which byte-level vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Seen(dict):
    """Pieces and their ids; a new one is encoded as it is looked up, and kept unless it is unlikely to come again."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self.learn(piece)
        if len(piece) <= 32 and "\n" not in piece:
            self[piece] = ids
        return ids


class SpanTokenizer:
    """Whole-text ids of a `tokenizers` file, by way of a bounded cache of its spans.

    A span (see BYTE_SPANS, WORD_SPANS) is a part of the text that the tokenizer's own pre-tokenization never joins
    to its neighbours, so the ids of a text are those of its spans in order. Each span is encoded by the library once
    and then looked up; natural text repeats its words, so this costs a fraction of encoding every text again. A span
    that is one run of Latin letters goes to the library's model directly, others through all its steps.

    Texts are first cut at spaces, which is quick, into pieces of one span or a few; a text whose white space would make
    that wrong (spaces in a row) is cut into spans right away.
    Ids are little-endian, of `width` bytes. Strings of special tokens in a text are ordinary text.
    The cache has two generations of `cap` pieces; what the older holds moves up when it is met."""

    def __init__(self, path: str, kind: str, width: int, cap: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.spans, self.drops_space = {"byte": (BYTE_SPANS, False), "word": (WORD_SPANS, True)}[kind]
        self.lead = "" if self.drops_space else " "
        self.width, self.cap, self.dtype = width, cap, f"<u{width}"
        self.kind = {2: "H", 4: "I"}[width]
        self.alphabet = _byte_alphabet()
        self.space = "" if self.drops_space else self.alphabet[ord(" ")]
        self.seen, self.old = _Seen(self._learn), {}  # pieces after a space, or of a tokenizer that drops spaces
        self.bare = _Seen(self._encode)  # spans without a space before them

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _encode(self, span: str) -> bytes:
        if _RUN.fullmatch(span):
            word = span.lower() if self.drops_space else span
            return self._packed([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])
        return self._packed(self.tok.encode(span, add_special_tokens=False).ids)

    def _learn(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is not None:
            return ids
        if piece.isascii() and piece.isalpha():  # one run of letters, each spelled as itself
            return self._packed([t.id for t in self.model.tokenize(self.space + (piece.lower() if self.drops_space else piece))])
        spans = self.spans.findall(self.lead + piece)
        if len(spans) == 1:
            return self._encode(spans[0])
        return self._join(spans)

    def _join(self, spans: list[str]) -> bytes:
        if self.drops_space:
            return b"".join(map(self.seen.__getitem__, spans))
        return b"".join(self.seen[s[1:]] if s[0] == " " and len(s) > 1 else self.bare[s] for s in spans)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.seen) > self.cap:
            self.old, self.seen = self.seen, _Seen(self._learn)
        if len(self.bare) > self.cap:
            self.bare.clear()
        if self.drops_space:
            if not _MARKS.search(text):
                text = text.encode().lower().decode()  # of A-Z only: fewer pieces to know
            pieces = self.spans.findall(text) if _NOT_SPACE.search(text) else text.split()
            return b"".join(map(self.seen.__getitem__, pieces))
        if _IN_A_ROW.search(text):
            return b"".join(self._join(self.spans.findall(part)) for part in slices(text))
        first, *pieces = text.split(" ")
        return (self._join(self.spans.findall(first)) if first else b"") + b"".join(map(self.seen.__getitem__, pieces))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=4)
def span_tokenizer(path: str, kind: str, width: int) -> SpanTokenizer:
    """One for each Python worker process, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return SpanTokenizer(path, kind, width)


def vocabulary_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


# --- crc32 of joined parts


def _times(matrix: list[int], vec: int) -> int:
    total, k = 0, 0
    while vec:
        if vec & 1:
            total ^= matrix[k]
        vec >>= 1
        k += 1
    return total


@lru_cache(maxsize=64)
def _zeros(power: int) -> tuple[int, ...]:
    """The operator on a crc of 2**power zero bits."""
    if power == 0:
        return (0xEDB88320, *(1 << k for k in range(31)))
    m = list(_zeros(power - 1))
    return tuple(_times(m, x) for x in m)


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """crc32 of a + b from those of a and b."""
    bits, power = second_bytes * 8, 0
    while bits:
        if bits & 1:
            first = _times(list(_zeros(power)), first)
        bits >>= 1
        power += 1
    return first ^ second
