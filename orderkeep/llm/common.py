"""What the operators of this subpackage share: reading tables, batches of text, workers' caches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.session import ship

#: Rows and bytes of an Arrow batch sent to a Python worker; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"

#: Entries of a worker's memo (twice as many with the old one's), and code points of the longest piece in it.
MEMO_ENTRIES, MEMO_CHARS = 150_000, 64

_HELD: dict[Any, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make workers able to import the package; keep their batches small unless the session says how large they are."""
    ship(spark)
    for name, own in (("maxRecordsPerBatch", str(BATCH_ROWS)), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, own)


def held(key: Any, make: Callable[[], Any]) -> Any:
    """make(), kept in this worker process under key; at most four things are kept."""
    if key not in _HELD:
        while len(_HELD) >= 4:
            _HELD.pop(next(iter(_HELD)))
        _HELD[key] = make()
    return _HELD[key]


class Pieces:
    """A pattern's matches in a text, as the regex module finds them.

    Texts of common characters only are matched by a twin of the pattern, for the faster module re, whose classes are
    written out: they are taken from what regex says of each of these characters. A pattern with other classes has none."""

    #: Code points: Latin, and general punctuation.
    COMMON = (*range(0x250), *range(0x2000, 0x2070))

    def __init__(self, pattern: str):
        import regex

        self.any = regex.compile(pattern).findall
        self.few = None
        own = {c: "".join(re.escape(chr(x)) for x in self.COMMON if regex.match(c, chr(x))) for c in (r"\p{L}", r"\p{N}", r"\s")}
        twin, plain = pattern.replace(r"\S", r"[^\s]"), pattern.replace(r"\S", "")
        for c in own:
            plain = plain.replace(c, "")
        if not re.search(r"\\|\[(?!\^?\])", plain):  # nothing but these classes, in brackets or not
            twin = re.sub(r"\[[^]]*\]|\\p\{[LN]\}|\\s", lambda m: m[0] if m[0][0] == "[" else f"[{m[0]}]", twin)
            for c, items in own.items():
                twin = twin.replace(c, items)
            self.few = re.compile(twin).findall
        self.rare = re.compile("[^" + re.escape(chr(0)) + "-\u024f\u2000-\u206f]").search

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.few is None or self.rare(text) else self.few(text)


class Memo(dict):
    """Piece of text to what make gives for it, filled as asked for. A memo of MEMO_ENTRIES becomes the old one, of which what
    is asked for again is taken over, so that frequent pieces stay. Pieces of over MEMO_CHARS aren't kept."""

    def __init__(self, make: Callable[[Any], Any], entries: int | None = None):
        super().__init__()
        self.make, self.old, self.entries = make, {}, entries or MEMO_ENTRIES

    def __missing__(self, piece: Any) -> Any:
        out = self.old.get(piece)
        if out is None:
            out = self.make(piece)
        if not isinstance(piece, str) or len(piece) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


def trim() -> None:
    """Give memory that nothing uses back to the system; a worker waits for its next task with what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for tasks that need memory: what other operators hold in this worker goes first, and unused memory goes after."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _HELD.clear()
        trim()
        yield from run(batches)
        trim()

    return alone


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str, keeps: str = "") -> DataFrame:
    """mapInArrow with a function of one batch that returns one batch or several. Of what the worker holds, things whose keys
    don't begin with `keeps` go first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key in [k for k in _HELD if k[0] != keeps]:
            del _HELD[key]
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        trim()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


#: The least key: it stands for a null id.
NULL_ID = -(2**63)
#: How finely bounds of ids are told (1 / ACCURACY of the rows); it matters for evenness only.
ACCURACY = 1_000_000


def parts_of(rows: DataFrame, part_bytes: int, text_col: str = "text") -> int:
    """How many parts of about part_bytes of text (16 more for each row) rows make, and not fewer than shuffles have."""
    size = rows.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16)).first()[0] or 0
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


class Cuts:
    """Cuts of a table into parts that ascend by (k, t): k an id, t a hash of the text, which cuts up an id of many rows.

    The driver gets a bound for each part."""

    def __init__(self, keys: DataFrame, parts: int):
        """keys: has k (long)."""
        bounds = (keys.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], min(20 * parts, ACCURACY))).first()[0] if parts > 1 else None) or []
        at, times = np.unique(np.array(bounds, np.int64), return_counts=True)
        # an id that is several bounds begins a part and is cut evenly by the hash
        self.k = np.repeat(at, times)
        self.t = np.concatenate([np.zeros(0, np.int64), *(np.array([NULL_ID + j * (1 << 64) // n for j in range(n)], object).astype(np.int64) for n in times.tolist())])
        self.many = at[times > 1]

    def __len__(self) -> int:
        return len(self.k) + 1

    def of(self, k: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The part of each row."""
        out = np.searchsorted(self.k, k, side="right")
        for x in self.many[np.isin(self.many, k)].tolist():
            a, b = np.searchsorted(self.k, [x, x + 1 if x < 2**63 - 1 else x], side="left")
            b = b if x < 2**63 - 1 else len(self.k)
            own = k == x
            out[own] = a + np.searchsorted(self.t[a:b], t[own], side="right")
        return out
