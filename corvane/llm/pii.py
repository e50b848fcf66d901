"""Personal data: entities by pattern, and terms that corpus co-occurrence shows to reveal them.

An entity is what a match says, and also the group that it belongs to (an address's domain, a network, a card's issuer, a
phone's area), so that entities said once are judged by what is known of their group too. A term near an entity reveals it
if knowing the term takes away most of the entity's information content: PMI(entity; term) >= THRESHOLD * IC(entity), with
IC = ln(N / df(entity)), PMI = ln(N * joint / (df(entity) * (df(term) + 1))), document frequencies over the whole corpus,
and joint the documents where the term stands near the entity. The 1 is a document not seen yet that has the term without
the entity: it keeps words said once from revealing a frequent group, and no entity is too rare to be judged. Terms never
said elsewhere (joint = df(term)) are removed, the others generalised to their class, wherever the document says them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import checkpoint, fresh, holder, lean, scratch, sieve, table

KINDS = ("email", "ip", "card", "phone")
METHOD = ("removed", "generalised")
#: Words on each side of an entity that are its context, threshold, words whose terms a task remembers,
#: parts of the corpus of which one gives the first lower bounds.
CONTEXT, THRESHOLD, HELD, SEED, PARTS = 10, 0.9, 1 << 16, 42, 8
#: What is stripped from a word's ends before it counts as a term.
MARKS = ".,;:!?()[]{}<>\"'«»„“”‚‘’…|*#%&$+=/\\-_~^`@"
REPLACED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": ""}

# The base rules' patterns. A match never begins inside a run of digits: were it possible there, it would have been at the
# run's start, so the look-behind changes no result and keeps long runs linear. Possessive runs likewise.
_LOCAL, _DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @, back over the local part to the last match at most, then on over the domain."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
        else:
            low = at + 1
        at = text.find("@", max(low, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive) by start, then kind as listed; none for null or empty text."""
    if not text:
        return []
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def entities(text: str, kind: str, start: int, end: int) -> tuple[str, str]:
    """What a match says, and the group that it belongs to."""
    value = text[start:end]
    if kind == "email":
        value = value.lower()
        return f"email:{value}", f"domain:{value.rpartition('@')[2]}"
    if kind == "ip":
        return f"ip:{value}", f"network:{value.rpartition('.')[0]}"
    digits = re.sub("[^0-9]", "", value)
    return f"{kind}:{digits}", f"issuer:{digits[:6]}" if kind == "card" else f"area:{digits[:-7]}"


def term_of(word: str) -> str | None:
    """The term that a word is: without marks at its ends, in lower case; None for fewer than 3 characters or no letter."""
    word = word.strip(MARKS)
    return word.lower() if len(word) >= 3 and any(map(str.isalpha, word)) else None


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), SEED) - (1 << 63)


class _Terms(dict):
    """By word: the 64-bit code of its term, or 0 if it is none (or ``may`` says no); forgets all when it is full."""

    def __init__(self, may: Callable[[int], bool] | None = None) -> None:
        super().__init__()
        self.may = may

    def __missing__(self, word: str) -> int:
        term = term_of(word)
        code = _code(term) if term else 0
        if code and self.may and not self.may(code):
            code = 0
        if len(self) >= HELD:
            self.clear()
        if len(word) < 64:
            self[word] = code
        return code


def contexts(text: str, spans: list[tuple[str, int, int]], terms: _Terms | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Pairs of entity and term codes, for the terms among the CONTEXT words on each side of an entity; and the term's code,
    start and end of every word of the text that says one of those terms. Words that touch a match are no terms."""
    terms = _Terms() if terms is None else terms
    at = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in at], [e for _, e in at]
    touched: set[int] = set()
    for _, s, e in spans:
        touched.update(range(bisect_right(ends, s), bisect_left(starts, e)))
    codes = [0 if k in touched else terms[text[s:e]] for k, (s, e) in enumerate(at)]
    pairs: dict[tuple[int, int], None] = {}
    for kind, start, end in spans:
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        near = [c for c in (*codes[max(0, left - CONTEXT) : left], *codes[right : right + CONTEXT]) if c]
        for name in entities(text, kind, start, end):
            code = _code(name)
            pairs.update(dict.fromkeys((code, c) for c in near))
    wanted = {c for _, c in pairs}
    places = []
    for k, c in enumerate(codes):
        if c in wanted:
            word = text[starts[k] : ends[k]]
            inner = word.strip(MARKS)
            begin = starts[k] + word.index(inner)
            places.append((c, begin, begin + len(inner)))
    return list(pairs), places


_SPANS, _PAIRS, _PLACES = "array<struct<kind:string,start:int,end:int>>", "array<struct<entity:bigint,term:bigint>>", "array<struct<term:bigint,start:int,end:int>>"


def _structs(rows: list[list[tuple]], names: tuple[str, ...], kinds: tuple) -> pa.Array:
    flat = [x for row in rows for x in row]
    columns = [pa.array([x[k] for x in flat], t) for k, t in enumerate(kinds)]
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.StructArray.from_arrays(columns, list(names)))


def _extract(docs: DataFrame, text: str, names: tuple[str, str, str], keep: bool) -> DataFrame:
    held = [f for f in docs.schema.fields if keep or f.name != text]
    positions, where = [docs.columns.index(f.name) for f in held], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            spans, near, places = [], [], []
            for t in batch.column(where):
                t = t.as_py()
                spans.append(base_spans(t))
                pairs, said = contexts(t, spans[-1], terms) if spans[-1] else ([], [])
                near.append(pairs)
                places.append(said)
            added = [
                _structs(spans, ("kind", "start", "end"), (pa.string(), pa.int32(), pa.int32())),
                _structs(near, ("entity", "term"), (pa.int64(), pa.int64())),
                _structs(places, ("term", "start", "end"), (pa.int64(), pa.int32(), pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in positions), *added], names=[*(f.name for f in held), *names])

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in held]
    return docs.mapInArrow(lean(run), ", ".join([*ddl, *(f"`{n}` {t}" for n, t in zip(names, (_SPANS, _PAIRS, _PLACES), strict=True))]))


def _frequencies(corpus: DataFrame, text: str, wanted: DataFrame, into: str) -> DataFrame:
    """term, ``into``: the documents of ``corpus`` that have each of the ``wanted`` terms (a few others may be counted too).

    Terms are counted by batch before they are dealt, and a sieve of those asked for holds most others back.
    """
    sent = corpus.sparkSession.sparkContext.broadcast(sieve(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(holder(sent.value))
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(0):
                n.update(set(map(terms.__getitem__, set(_WORD.findall(t.as_py() or "")))))
            del n[0]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    return corpus.select(text).mapInArrow(lean(run), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias(into))


def _revealing(corpus: DataFrame, text: str, marked: DataFrame, near: str, threshold: float) -> DataFrame:
    """entity, term, kind for the terms that reveal an entity, by counts over all of ``corpus``."""
    total = float(corpus.count())
    by_doc = marked.where(F.size(near) > 0).select(near)
    joint = by_doc.select(F.explode(near).alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("joint"))
    entity = by_doc.select(F.explode(F.array_distinct(F.transform(near, lambda c: c["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity"))
    near_term = by_doc.select(F.explode(F.array_distinct(F.transform(near, lambda c: c["term"]))).alias("term")).groupBy("term").agg(F.count("*").alias("df_near"))

    def reveals(df_term: str):
        ic = F.log(F.lit(total) / F.col("df_entity"))
        pmi = F.log(F.lit(total) * F.col("joint") / (F.col("df_entity").cast("double") * (F.col(df_term) + 1)))
        return (ic > 0) & (pmi >= ic * threshold)

    # PMI falls as a term's frequency rises, so any lower bound of that frequency rules out pairs for good: first the
    # documents where the term is near an entity, then its count in one part of the corpus. Common words go by these, and
    # the count over all documents is taken of rare terms only.
    joint = checkpoint(joint.join(entity, "entity").join(near_term, "term").where(reveals("df_near")).drop("df_near"))
    part = corpus.where(F.pmod(F.xxhash64(text), F.lit(PARTS)) == 0)
    least = _frequencies(part, text, joint.select("term").distinct(), "df_least")
    joint = checkpoint(joint.join(least, "term", "left").where(F.col("df_least").isNull() | reveals("df_least")).drop("df_least"))
    df_term = _frequencies(corpus, text, joint.select("term").distinct(), "df_term")
    kind = F.when(F.col("joint") >= F.col("df_term"), METHOD[0]).otherwise(METHOD[1])
    return joint.join(df_term, "term").where(reveals("df_term")).select("entity", "term", kind.alias("kind"))


def find(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, keep: bool = True, corpus: DataFrame | None = None) -> DataFrame:
    """Adds base (spans by pattern) and terms (spans of revealing terms): arrays of kind, start, end, sorted.

    Counts are over ``corpus`` (``docs`` if none). Null and empty texts have no spans. Repeated rows count as documents of
    their own. Entities and terms of any frequency are counted by task before they are dealt, and the join of a frequent
    pair is split by adaptive execution. Texts of any length are searched whole. An empty table stays empty. The added
    names get underscores in front where ``docs`` has them. keep: with the text.
    """
    spark = docs.sparkSession
    corpus = docs if corpus is None else corpus
    base, near, places, rid, terms, row = fresh(docs, "base", "near", "places", "rid", "terms", "row")
    path = scratch(spark, "pii")
    # Written once: the row numbers hold from here on, whatever executors are lost.
    _extract(docs, text, (base, near, places), keep).withColumn(rid, F.monotonically_increasing_id()).write.parquet(path)
    marked = spark.read.parquet(path)
    revealing = _revealing(corpus, text, marked, near, threshold)
    seen = marked.where(F.size(near) > 0).select(F.col(rid).alias("r"), F.explode(near).alias("c")).select("r", "c.entity", "c.term")
    hit = seen.join(revealing, ["entity", "term"]).groupBy("r", "term").agg(F.max("kind").alias("kind"))  # "removed" is the larger name
    held = marked.where(F.size(near) > 0).select(F.col(rid).alias("r"), F.explode(places).alias("p")).select("r", "p.term", "p.start", "p.end")
    spans = held.join(hit, ["r", "term"]).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("found"))
    spans = spans.select(F.col("r").alias(row), F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(terms))
    none = F.array().cast(_SPANS)
    with_terms = marked.where(F.size(near) > 0).join(spans, F.col(rid) == F.col(row), "left").withColumn(terms, F.coalesce(terms, none))
    without = marked.where(F.size(near) == 0).withColumn(terms, none)
    out = [c for c in marked.columns if c not in (near, places, rid)]
    return with_terms.select(*out, terms).unionByName(without.select(*out, terms))


def general(word: str) -> str:
    """The class that a term is generalised to: a code, a name or a word."""
    return "[CODE]" if any(map(str.isdigit, word)) else "[NAME]" if word[:1].isupper() else "[WORD]"


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced; of overlapping spans the first stands for all that they cover."""
    out, at, last = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < last:
            last = max(last, end)
            at = last
            continue
        out += [text[at:start], REPLACED[kind] if kind in REPLACED else general(text[start:end])]
        at = last = end
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with entities masked and revealing terms removed or generalised in ``text``; every row stays.

    Texts without a digit or @ have no entity and pass by untouched, null and empty ones too; the rest as find() says.
    """
    may = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    base, terms = fresh(docs, "base", "terms")
    found = find(docs.where(may), text, threshold, corpus=docs)
    where, columns = docs.columns.index(text), docs.columns
    fields = docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for t, b, k in zip(batch.column(where), batch.column(len(fields)), batch.column(len(fields) + 1), strict=True):
                spans = [(s["kind"], s["start"], s["end"]) for s in (*b.as_py(), *k.as_py())]
                new.append(redact(t.as_py(), spans) if spans else t.as_py())
            arrays = [batch.column(i) for i in range(len(fields))]
            arrays[where] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return found.select(*columns, base, terms).mapInArrow(run, ddl).unionByName(docs.where(~may))


def query(spark, sf_dir):
    """op6: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    ranks = F.create_map(*(x for k, kind in enumerate((*KINDS, *METHOD)) for x in (F.lit(kind), F.lit(k))))
    every = F.sort_array(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), ranks[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"))
