"""Secret scans: all rules as one automaton, run over whole texts in one byte pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Combined

#: Bytes of text that one pass takes at least, if there are as many.
CHUNK_BYTES = 8 << 20
SPANS = "spans array<struct<kind string, start long, end long>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` that have ``least`` bytes or more; with ``assigned``, what stands after the first : or =, blanks and a quote must have them."""

    kind: str
    pattern: str
    least: int = 0
    assigned: bool = False

    def holds(self, match: bytes) -> bool:
        if self.assigned:
            match = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
            match = match[1:] if match[:1] in (b'"', b"'") else match
        return len(match) >= self.least


# The three base rules, then public formats of keys. A run of 16 hex digits or more is the same whether short runs are matched and dropped or not matched.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE = (
    Rule("pem", r"-----BEGIN ((RSA|EC|DSA|OPENSSH) )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}"),
)
RULES = BASE + MORE


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Combined:
    """The rules' automaton, built once a process."""
    found = Combined([r.pattern for r in rules])
    if not found.resets_on(ord("\n")):
        raise ValueError("no rule may match over a line end")
    return found


def spans_of(texts: Sequence[bytes], rules: tuple[Rule, ...] = RULES, scanner: Combined | None = None) -> list[list[tuple[int, int, int]]]:
    """For each UTF-8 text its (rule, start, end) in code points, by start, then rule; all texts in one pass."""
    scanner = scanner or automaton(rules)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    for rule, start, end in scanner.matches(b"\n".join(texts)):
        which = int(np.searchsorted(starts, start, side="right")) - 1
        low = int(starts[which])
        if rules[rule].holds(texts[which][start - low : end - low]):
            out[which].append((rule, start - low, end - low))
    for i, (text, spans) in enumerate(zip(texts, out, strict=True)):
        if spans and not text.isascii():
            before = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)  # code points begun up to each byte
            spans = [(rule, int(before[start]) - 1, int(before[end - 1])) for rule, start, end in spans]
        out[i] = sorted(spans, key=lambda s: (s[1], s[0]))
    return out


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): where each whole text holds secrets, a row a document.

    Spans are in code points, end exclusive, by start and then by the order of
    the rules; matches of one kind don't overlap, those of several may. Null and empty
    texts have none. Rows that share a doc_id are scanned each on its own, null
    ids too; no rows give no rows; extra columns take no part. Nothing is
    shuffled. A task joins texts to chunks of a few MB, so that the automaton
    runs on thousands of places at once; a longer text is a chunk of its own,
    whatever its length. The automaton is built on the driver and travels with
    the tasks, about a MB.
    """
    scanner = automaton(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r.kind for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            low = size = 0
            for i, text in enumerate(texts):
                size += len(text) + 1
                if size >= CHUNK_BYTES or i == len(texts) - 1:
                    found = [[{"kind": kinds[r], "start": a, "end": b} for r, a, b in spans] for spans in spans_of(texts[low : i + 1], rules, scanner)]
                    yield pa.RecordBatch.from_arrays([ids[low : i + 1], pa.array(found, kind)], names=["doc_id", "spans"])
                    low, size = i + 1, 0

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {SPANS}")


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    spans, base = F.col("spans"), [r.kind for r in BASE]
    counts = [count_of(spans, k).alias(f"n_{k}") for k in base]
    own = F.filter(spans, lambda s: s["kind"].isin(base))
    return secret_spans(docs).select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
