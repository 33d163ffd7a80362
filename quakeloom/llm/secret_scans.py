"""Secret scans with one combined deterministic automaton.

All rules are compiled into one automaton that reads a text backwards, so that a single pass over its
bytes marks every place where some rule's match starts. Pieces of texts are read side by side, a byte of
each at a time. From the leftmost mark of each rule a small
automaton of that rule runs forward to the longest end; marks before that end are skipped. This gives
the leftmost, longest, non-overlapping matches per rule. Matches that are too short are dropped after
that, and still hide what they cover.

Defined results: null and empty texts have no secrets; every row is scanned whole and answered by
itself, repeated rows too; offsets are code points, ends exclusive; columns other than doc_id and text
(and those the redacting form passes through) are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import textscan
from quakeloom.llm.automata import Dfa, compile_rules
from quakeloom.session import table


@dataclass(frozen=True)
class Rule:
    """A match is `prefix` then `value`; `shortest` code points of the value, or of all if `whole`."""

    kind: str
    prefix: str
    value: str
    shortest: int
    whole: bool = True
    ignore_case: bool = False


#: Fixed rules of the contract. A run of 16 is asked for in the pattern itself: runs are maximal, so
#: that shorter ones can't hide a longer one.
BASE_RULES = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, whole=False, ignore_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 18),
    Rule("hex", r"", r"[0-9a-f]{16,}", 16),
)
#: Publicly documented token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 40),
    Rule("google", r"AIza", r"[0-9A-Za-z_-]+", 39),
    Rule("slack", r"xox[abprs]-", r"[0-9A-Za-z-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN ", r"(?:[A-Z]+ )*PRIVATE KEY-----", 27),
)
RULES = BASE_RULES + MORE_RULES


#: What follows the header line of a private key: long runs of base64, lines of base64 only (quoted,
#: indented or with written-out line breaks too), headers of encrypted keys, and the END line.
_SEPARATOR, _PAD, _BREAK = rb"""(?:[\s>#*"'`,;]|\\[nrt])*+""", rb"""[ \t>#*"'`,;]*+""", rb"(?:\r\n?|\n|(?:\\r)?\\n)"
_RUN = rb"[A-Za-z0-9+/]"
KEY_BODY = re.compile(b"".join([
    rb"(?:", _SEPARATOR, _RUN, rb"{16,}+={0,2}",
    rb"|", _SEPARATOR, _RUN, rb"++={0,2}(?=", _SEPARATOR, rb"-----END )",
    rb"|", _PAD, rb"(?:", _BREAK, _PAD, rb")++", _RUN, rb"++={0,2}(?=", _PAD, rb"(?:", _BREAK, rb"|\Z))",
    rb"|", _SEPARATOR, rb"(?:Proc-Type|DEK-Info|Comment|Version):[^\r\n\\]*+)*+",
    rb"(?:", _SEPARATOR, rb"-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
]))


@lru_cache(maxsize=8)
def _compiled(rules: tuple[Rule, ...]) -> tuple:
    """The backward automaton of all rules, and per rule the forward ones of prefix and whole."""
    parts = [[(r.prefix, r.ignore_case), (r.value, False)] for r in rules]
    forward = [(compile_rules([p[:1]]), compile_rules([p])) for p in parts]
    return compile_rules(parts, backward=True, anywhere=True), forward


#: Bytes of a text that one lane of the backward pass reads, and bytes before these from which it guesses its state.
LANE, WARM = 512, 48


def _read(step: np.ndarray, data: np.ndarray, state: np.ndarray, begin: np.ndarray, stop: np.ndarray, first: int | None = None) -> tuple[np.ndarray, list]:
    """All lanes at once, a byte of each at a time, from `begin` (exclusive) down to `stop`: the states in the end
    and, if `first` is given, places and states of all steps to a state from `first` on, with the lane."""
    order = np.argsort(stop - begin, kind="stable")
    at, now, lengths = begin[order] - 1, state[order].copy(), (begin - stop)[order]
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    for i, n in enumerate(active.tolist()):
        now[:n] = step[now[:n] + data[at[:n] - i]]
        if first is not None:
            hit = np.flatnonzero(now[:n] >= first)
            if len(hit):
                hits.append((order[hit], at[hit] - i, now[hit]))
    out = np.empty_like(now)
    out[order] = now
    return out, hits


def _marks(auto: Dfa, step: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where matches start in the texts of a buffer, in order, and the bits of their rules.

    Texts are cut into lanes that are read side by side. A lane's first state is guessed from the bytes
    before it; where that isn't the state in which the lane before ended, it is read again from there.
    """
    sizes = np.diff(offsets)
    lanes = -(-sizes // LANE)
    text = np.repeat(np.arange(len(sizes)), lanes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    end = offsets[1:][text]
    begin = end - place * LANE
    stop = np.maximum(offsets[:-1][text], begin - LANE)
    guess, _ = _read(step, data, np.full(len(text), auto.start), np.minimum(end, begin + WARM), begin)
    last, hits = _read(step, data, guess, begin, stop, auto.first_accept)
    while len(wrong := np.flatnonzero((place > 0) & (guess != np.concatenate([[auto.start], last[:-1]])[: len(last)]))):
        guess[wrong] = last[wrong - 1]
        hits = [(lane[k], at[k], state[k]) for lane, at, state in hits if len(k := np.flatnonzero(~np.isin(lane, wrong)))]
        again, more = _read(step, data, guess[wrong], begin[wrong], stop[wrong], auto.first_accept)
        last[wrong] = again
        hits += [(wrong[lane], at, state) for lane, at, state in more]
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, state = (np.concatenate(x) for x in list(zip(*hits))[1:])
    order = np.argsort(at)
    return at[order], np.array(auto.accepts)[state[order] >> 8]


@lru_cache(maxsize=8)
def _table_of(rules: tuple[Rule, ...]) -> np.ndarray:
    return np.array(_compiled(rules)[0].step, np.int64)


def find_all(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int, int]]]:
    """(start, rule number, end, start of the value) of every secret of each text, in its bytes, by start then rule."""
    marks, forward = _compiled(rules)
    at, bits = _marks(marks, _table_of(rules), data, offsets)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    owner = np.searchsorted(offsets, at, side="right") - 1
    for d in np.unique(owner).tolist():
        raw, found, covered = data[offsets[d] : offsets[d + 1]].tobytes(), out[d], [0] * len(rules)
        own = slice(*np.searchsorted(owner, [d, d + 1]).tolist())
        for start, which in zip((at[own] - offsets[d]).tolist(), bits[own].tolist()):
            for n, rule in enumerate(rules):
                if which >> n & 1 and start >= covered[n]:
                    prefix, whole = forward[n]
                    covered[n] = end = whole.longest(raw, start)
                    value = max(prefix.longest(raw, start), start)
                    if end - (start if rule.whole else value) >= rule.shortest:
                        found.append((start, n, end, value))
    return out


def find(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, int]]:
    """The secrets of one text."""
    return find_all(np.frombuffer(data, np.uint8), np.array([0, len(data)]), rules)[0]


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and secrets: array of (kind, start, end, value_start) in code points, of each document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches):
            data, offsets = textscan.buffer(batch.column("text"))
            points = textscan.code_points(data)
            out = []
            for a, found in zip(offsets[:-1].tolist(), find_all(data, offsets, rules)):
                place = lambda i, a=a: int(points[a + i] - points[a])
                out.append([{"kind": rules[n].kind, "start": place(s), "end": place(e), "value_start": place(v)} for s, n, e, v in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SECRETS)], names=["doc_id", "secrets"])

    source = documents.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, secrets array<struct<kind:string,start:bigint,end:bigint,value_start:bigint>>")


_SECRETS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())]))


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with each secret's value replaced by `mask`; overlapping values by one mask. A private
    key goes with its body.

    Text and, where there is one, n_chars change; all other columns pass through, nulls stay null.
    """
    source = documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches):
            texts = batch.column("text").to_pylist()
            new, lengths = [], []
            for text, found in zip(texts, find_all(*textscan.buffer(batch.column("text")), rules)):
                raw, kept, at = text.encode() if found else b"", [], 0
                for start, end in _merged([(v, KEY_BODY.match(raw, e).end() if rules[n].kind == "private_key" else e) for _, n, e, v in found]):
                    kept += [raw[at:start], mask.encode()]
                    at = end
                new.append(text if not kept else b"".join([*kept, raw[at:]]).decode())
                lengths.append(len(new[-1]) if kept else None)
            columns = dict(zip(batch.schema.names, batch.columns)) | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([o if n is None else n for n, o in zip(lengths, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return source.mapInArrow(run, source.schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _joined(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    secrets = F.col("secrets")
    of = lambda *kinds: F.filter(secrets, lambda s: s["kind"].isin(list(kinds)))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(_joined(of(*(r.kind for r in BASE_RULES))), 256).alias("base_sha256"), _joined(secrets).alias("spans"))


def _oracle() -> str:
    found = []
    for n, r in enumerate(RULES):
        # ASCII letters only: a case-insensitive group would take in the long s and the Kelvin sign
        either = re.sub(r"\\x[0-9a-f]{2}|[a-z]", lambda m: m[0] if m[0][0] == "\\" else f"[{m[0]}{m[0].upper()}]", r.prefix)
        whole = (either if r.ignore_case else r.prefix) + f"({r.value})"
        quoted = whole.replace("'", "''")
        found.append(f"""SELECT doc_id, {n} AS k, '{r.kind}' AS kind, unnest(list_zip(regexp_extract_all(text, '{quoted}', 0), regexp_extract_all(text, '{quoted}', 1),
  string_split_regex(text, '{quoted}'), range(0, len(regexp_extract_all(text, '{quoted}')) + 1))) AS z, {r.shortest} AS shortest, {str(r.whole).lower()} AS whole FROM d""")
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(found)}),
p AS (SELECT doc_id, k, kind, z[1] AS hit, z[2] AS val, shortest, whole,
  sum(length(z[3]) + coalesce(length(z[1]), 0)) OVER (PARTITION BY doc_id, k ORDER BY z[4]) AS stop FROM m),
s AS (SELECT doc_id, k, kind, stop - length(hit) AS start, stop FROM p WHERE hit IS NOT NULL AND length(CASE WHEN whole THEN hit ELSE val END) >= shortest),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, k) FILTER (k < 3) AS base,
  string_agg(concat(kind, ':', start::BIGINT, ':', stop::BIGINT), ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)"""


QUERIES = {"op4_secret_scans": op4_secret_scans}
ORACLE_SQL = {"op4_secret_scans": _oracle()}
