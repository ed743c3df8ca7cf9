"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers they miss.

1. The base spans of four kinds are the seeds. Besides, every text yields candidates: strings shaped like a kind that no base pattern
   accepts, such as "name at host dot org" or a phone number without its plus. Seeds and candidates are instances;
   the words around each mention are its lexical patterns.
2. Patterns that extract LEAST_SEEDS different seeds, and mostly such, are taken to all texts: whatever stands in their slot and could be an identifier
   is an instance too, of any shape. So a pattern that many other things follow loses its confidence.
3. Pattern and instance form a bipartite graph of distinct pairs, which Spark scores in rounds: a pattern's confidence is the share of accepted instances
   among all it extracts, if it extracts LEAST_SEEDS different accepted ones; an instance's is one minus the product of its
   patterns' doubts; instances of LEAST_SCORE or more are accepted and strengthen patterns in the next round. Mentions of
   accepted instances become spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import batch_rows, materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_SEEDS = 5
#: Patterns that are taken to the texts at once.
PATTERNS = 50_000
LEAST_CONFIDENCE = 0.6
LEAST_SCORE = 0.8

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\}|\bat\b)\s?", re.IGNORECASE)
#: Set off by brackets or white space, so that no two matches look at the same word before or after.
_AT_APART = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\})\s?|\sat\s", re.IGNORECASE)
_SPELT_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\sdot\s)[A-Za-z0-9-]+)+", re.IGNORECASE)
_DIGITS = re.compile(r"\(?[0-9](?:[ ()./_-]{0,2}[0-9])+")
_V6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
_TOKEN = re.compile(r"\w+|[^\w\s]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: from each @ back over the local part and on over the host."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers each, from the left of every chain of dotted numbers; chains are found whole, so time is linear."""
    if text.count(".") < 3:
        return
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, at + size
                at += size + 1


def base_spans(text: str) -> list[Span]:
    """(start, end, kind number) of the base patterns, by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] + [(a, b, 1) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Strings shaped like a kind that overlap no base span and no earlier candidate; a number is one of every kind its digits allow."""
    found: list[Span] = []
    if "dot" in text or "DOT" in text or "Dot" in text:
        for m in _AT.finditer(text):
            host = _SPELT_HOST.match(text, m.end())
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            if host and start < m.start():
                found.append((start, host.end(), 0))
    for m in _AT_APART.finditer(text):
        host = _HOST.match(text, m.end())
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < m.start():
            found.append((start, host.end(), 0))
    if ":" in text:
        found += [(m.start(), m.end(), 1) for m in _V6.finditer(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        n = sum(c.isdigit() for c in m[0])
        if 12 <= n <= 19 and m[0][0] != "(":
            found.append((m.start(), m.end(), 2))
        if 7 <= n <= 15:
            found.append((m.start(), m.end(), 3))
    if not found:
        return []
    out: list[Span] = []
    busy = sorted((a, b) for a, b, _ in taken)
    k, last = 0, 0
    for a, b, kind in sorted(found):
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        if (a >= last or (out and out[-1][:2] == (a, b) and out[-1][2] != kind)) and not (k < len(busy) and busy[k][0] < b):
            out.append((a, b, kind))
            last = b
    return out


def contexts(text: str, span: Span) -> list[str]:
    """The lexical patterns of a mention: words before and after it, digits as 0."""
    left = [re.sub(r"[0-9]", "0", t.lower()) for t in _TOKEN.findall(text[max(0, span[0] - 60) : span[0]])][-3:]
    right = [re.sub(r"[0-9]", "0", t.lower()) for t in _TOKEN.findall(text[span[1] : span[1] + 60])][:2]
    k = KINDS[span[2]]
    out = []
    if left:
        out.append(f"{k}|{left[-1]}|")
    if len(left) > 1:
        out.append(f"{k}|{' '.join(left[-2:])}|")
    if len(left) > 2:
        out.append(f"{k}|{' '.join(left)}|")
    if left and right:
        out.append(f"{k}|{left[-1]}|{right[0]}")
    if len(right) > 1:
        out.append(f"{k}||{' '.join(right)}")
    return out


#: What may stand in a slot: a run without white space, less its outer punctuation, of such a length and with a digit or an at sign.
_OUTER = ".,;:!?()[]{}<>\"'"
SLOT_LENGTH = (5, 64)
_ZEROS = str.maketrans("123456789", "000000000")
#: A run from its first digit (of str.isdigit, which knows some that \d lacks) or at sign on. Beyond 16 bits any character will do here, so that the set stays a quick one.
_MARK = re.compile("[@" + "".join(c for c in map(chr, range(0x10000)) if c.isdigit()) + "\U00010000-\U0010ffff]" + r"\S*")
_WORD_CHAR = re.compile(r"\w")


def fillers(text: str) -> Iterator[tuple[int, int, int]]:
    """(end of the token before, start, end) of all that may stand in a slot, once for each token end from which only punctuation and white space lead to it.

    Sought from the digits and at signs, which are few; time is linear in the text.
    """
    for m in _MARK.finditer(text):
        end = m.start() + len(m[0].rstrip(_OUTER))
        start, marked, at = end, False, end
        while at > 0 and start >= end - SLOT_LENGTH[1]:
            at -= 1
            c = text[at]
            if c.isspace():
                # the word is led to from the run before too, whose end is the end of a token
                while at > 0 and text[at - 1].isspace():
                    at -= 1
                if at and marked and SLOT_LENGTH[0] <= end - start <= SLOT_LENGTH[1]:
                    yield at, start, end
                break
            if c not in _OUTER:
                start = at
                marked = marked or c == "@" or c.isdigit()
            if at and marked and SLOT_LENGTH[0] <= end - start <= SLOT_LENGTH[1]:
                before = text[at - 1]
                if not before.isspace() and not (_WORD_CHAR.match(before) and _WORD_CHAR.match(c)):
                    yield at, start, end


class Slots:
    """Finds what accepted left patterns "kind|words|" extract. What could stand in a slot is sought first, then the words before it are looked up."""

    def __init__(self, patterns: list[str]) -> None:
        self.known: dict[str, list[tuple[int, str]]] = {}
        for p in patterns:
            kind, words, _ = p.split("|")
            self.known.setdefault(words, []).append((KINDS.index(kind), p))
        self.last = {w.split(" ")[-1] for w in self.known}
        self.most = max((w.count(" ") + 1 for w in self.known), default=0)

    def __call__(self, text: str, taken: Callable[[str], list[Span]]) -> list[tuple[int, int, int, list[str]]]:
        """(start, end, kind, patterns), none of which overlaps a taken span or an earlier one of its kind. taken is asked only if there is something."""
        found: dict[tuple[int, int, int], list[str]] = {}
        for at, start, end in fillers(text):
            recent = [t.lower().translate(_ZEROS) for t in _TOKEN.findall(text[max(0, at - 60) : at])[-self.most :]]
            if recent[-1] not in self.last:
                continue
            for n in range(1, len(recent) + 1):
                for kind, p in self.known.get(" ".join(recent[-n:]), ()):
                    found.setdefault((start, end, kind), []).append(p)
        out, busy, k, last = [], sorted((a, b) for a, b, _ in taken(text)) if found else [], 0, {}
        for (a, b, kind), ps in sorted(found.items()):
            while k < len(busy) and busy[k][1] <= a:
                k += 1
            if not (k < len(busy) and busy[k][0] < b) and a >= last.get(kind, 0):
                out.append((a, b, kind, sorted(set(ps))))
                last[kind] = b
        return out


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])
_MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_ROWS = "doc_id long, text_key long, base array<struct<start: bigint, end: bigint, kind: int>>, mentions array<struct<start: bigint, end: bigint, kind: int, seed: boolean, instance: string, patterns: array<string>>>"


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, mentions) of each row; mentions are the seeds and candidates with their patterns."""
    ship(docs)
    batch_rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, base, found = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                more = candidates(text, spans)
                keys.append(_key(text))
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                found.append([{"start": s[0], "end": s[1], "kind": s[2], "seed": seed, "instance": f"{s[2]}:{text[s[0] : s[1]].lower()}", "patterns": contexts(text, s)} for group, seed in ((spans, True), (more, False)) for s in group])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_MENTION))], ["doc_id", "text_key", "base", "mentions"])

    return docs.select("doc_id", "text").mapInArrow(run, _ROWS)


def _taken(text: str) -> list[Span]:
    spans = base_spans(text)
    return spans + candidates(text, spans)


def open_patterns(edges: DataFrame, *, least_seeds: int = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(pattern): those of two words or more before the slot and none behind it whose instances are seeds, so many and in such a share."""
    left = F.substring_index(F.substring_index("pattern", "|", 2), "|", -1)
    some = edges.filter(F.col("pattern").endswith("|") & F.contains(left, F.lit(" "))).groupBy("pattern").agg(F.count_if("seed").alias("f"), F.count("*").alias("n"))
    return some.filter((F.col("f") >= least_seeds) & (F.col("f") >= least_confidence * F.col("n"))).select("pattern")


def slot_mentions(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(doc_id, text_key, mentions): what the patterns extract from each text and neither a base pattern nor a candidate's shape covers."""
    ship(docs)
    batch_rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(patterns)
        for batch in batches:
            ids, keys, found = [], [], []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                more = slots(text, _taken)
                if more:
                    ids.append(doc_id)
                    keys.append(_key(text))
                    found.append([{"start": a, "end": b, "kind": k, "seed": False, "instance": f"{k}:{text[a:b].lower()}", "patterns": ps} for a, b, k, ps in more])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(found, pa.list_(_MENTION))], ["doc_id", "text_key", "mentions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS.replace("base array<struct<start: bigint, end: bigint, kind: int>>, ", ""))


def _edges(rows: DataFrame) -> DataFrame:
    flat = rows.select(F.explode("mentions").alias("m"))
    return flat.select(F.explode("m.patterns").alias("pattern"), F.col("m.instance").alias("instance"), F.col("m.seed").alias("seed")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def bootstrap(edges: DataFrame, *, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_confidence: float = LEAST_CONFIDENCE, least_score: float = LEAST_SCORE) -> DataFrame:
    """(instance): the accepted instances that are no seeds, from edges(pattern, instance, seed).

    The graph holds each pair of pattern and instance once, so copies of a text add nothing to a pattern's count.
    """
    accepted = materialize(edges.filter("seed").select("instance").distinct(), "accepted0")
    for k in range(rounds):
        marked = edges.join(accepted.withColumn("in", F.lit(1)), "instance", "left")
        patterns = marked.groupBy("pattern").agg(F.count("in").alias("f"), F.count("*").alias("n")).withColumn("confidence", F.col("f") / F.col("n"))
        # written first, so that the join deals its rows anew and a pattern of very many instances can be split
        patterns = materialize(patterns.filter((F.col("f") >= least_seeds) & (F.col("confidence") >= least_confidence)).select("pattern", "confidence"), f"patterns{k}")
        # a pattern is right with its confidence at most; rounding keeps sums of logs from depending on their order
        doubt = F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(0.05)))
        scored = edges.filter("not seed").join(patterns, "pattern").groupBy("instance").agg(F.round(F.lit(1.0) - F.exp(F.sum(doubt)), 9).alias("score"))
        accepted = materialize(accepted.unionByName(scored.filter(F.col("score") >= least_score).select("instance")).distinct(), f"accepted{k + 1}")
    return accepted.join(edges.filter("seed").select("instance").distinct(), "instance", "left_anti")


def _joined(spans: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs(doc_id, text).

    The counts and base_sha256 are of the base spans; spans has the added ones too. Null and empty texts have none. Repeated
    rows: each gets its spans, and counts once in the graph. Positions are code points, end exclusive. doc_id is a whole number or null; other
    columns are not read; an empty table gives an empty result.
    """
    rows = materialize(mentions(docs), "mentions")
    edges = materialize(_edges(rows), "graph")
    chosen = {k: v for k, v in options.items() if k in ("least_seeds", "least_confidence")}
    patterns = materialize(open_patterns(edges, **chosen), "open")  # type: ignore[arg-type]
    found = rows.select("doc_id", "text_key", F.filter("mentions", lambda m: ~m["seed"]).alias("mentions"))
    # a pass over the texts for every PATTERNS patterns or so, of which there is seldom more than one
    passes = math.ceil(patterns.count() / PATTERNS)
    for k in range(passes):
        mine = sorted(r["pattern"] for r in patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k).collect())
        slots = materialize(slot_mentions(docs, mine), f"slots{k}")
        found = found.unionByName(slots)
        edges = materialize(edges.unionByName(_edges(slots)).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), f"slot-graph{k}")
    new = bootstrap(edges, **options)  # type: ignore[arg-type]
    open_ = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.instance", F.struct("m.start", "m.end", "m.kind").alias("span"))
    added = open_.join(new, "instance").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_set("span").alias("added"))
    out = rows.select("doc_id", "text_key", "base").join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    out = out.withColumn("added", F.coalesce("added", F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: int>>)")))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
