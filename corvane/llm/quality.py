"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fresh, let, words

#: Symbols that count as markup noise, and frequent function words of the languages served.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a an and are as at be but by for from has have he her his i in is it not of on or she that the they this to was we were which with you".split()
    + "als auch auf aus bei das dass dem den der des die ein eine einer er es für ich im ist mit nicht sich sie so und von war wie zu zum".split()
    + "au aux avec ce dans de des du elle en est et il je la le les mais ne nous on ou par pas pour que qui sa se ses son sur un une".split()
    + "al como con de del el ella en es esta fue ha la las lo los más no o para pero por que se si sin sobre su sus un una y".split()
)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: keep a text if ``low <= numerator / denominator <= high``; an empty denominator passes.

    least: words below which a text is too short for the ratio to tell, and passes.
    """

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None
    least: int = 0

    def column(self, stats: Column) -> Column:
        top = stats[self.numerator]
        held = F.lit(True)
        # Compared as products: no division, so no rounding and no division by zero.
        base = stats[self.denominator] if self.denominator else F.lit(1)
        if self.low is not None:
            held = held & (top >= base * F.lit(self.low))
        if self.high is not None:
            held = held & (top <= base * F.lit(self.high))
        return held | (stats["n_words"] < self.least) if self.least else held

    def sql(self) -> str:
        base = self.denominator or "1"
        parts = [f"{self.numerator} >= {base} * CAST({self.low!r} AS DOUBLE)"] * (self.low is not None)
        parts += [f"{self.numerator} <= {base} * CAST({self.high!r} AS DOUBLE)"] * (self.high is not None)
        held = " AND ".join(parts) or "TRUE"
        return f"({held}) OR n_words < {self.least}" if self.least else held


#: The method's own thresholds; the base rules (fewer than 10 words, over 20 % repeated) come before them.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2.0, high=16.0),
    Rule("symbols a word", "n_symbols", "n_words", high=0.2),
    Rule("exclaimed words", "n_exclaimed", "n_words", high=0.5),
    Rule("stop words", "n_stop", "n_words", low=0.02, least=30),
    Rule("duplicate lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("ellipsis lines", "n_ellipsis", "n_lines", high=0.5),
    Rule("bullet lines", "n_bullets", "n_lines", high=0.9),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_exclaimed", "n_ellipsis", "n_bullets")


def _repeat_words(ws: Column) -> Column:
    """Words in windows that occur twice or more.

    Windows are compared by 64-bit chained hashes. Few texts have any repeat, so the sort that finds their
    places runs only where the hashes aren't distinct; all steps are linear but for that sort.
    """
    n = F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))
    keys = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, WINDOW)))), F.lit(1), n)

    def covered(ks: Column) -> Column:
        ordered = F.sort_array(F.transform(ks, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
            found = F.filter(s, lambda x, j: (twin(x, j + 1)) | (twin(x, j - 1)))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(ordered, places), total)

    return let(keys, lambda ks: F.when(F.size(F.array_distinct(ks)) < F.size(ks), covered(ks)).otherwise(F.lit(0).cast("long")))


def statistics(text: Column) -> Column:
    """A struct of STATS for a text; all zero for null or empty text."""
    t = F.coalesce(text, F.lit(""))
    count = lambda xs, f: F.size(F.filter(xs, f))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))

    def of(ws: Column, ls: Column) -> Column:
        parts = {
            "n_words": F.size(ws),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
            "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": _repeat_words(ws),
            "n_lines": F.size(ls),
            "n_stop": count(ws, lambda w: F.lower(w).isin(sorted(set(STOP_WORDS)))),
            "n_exclaimed": count(ws, lambda w: F.endswith(w, F.lit("!!"))),
            "n_ellipsis": count(ls, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…"))),
            "n_bullets": count(ls, lambda x: F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("* ")) | F.startswith(x, F.lit("• "))),
        }
        return F.struct(*(c.cast("long").alias(k) for k, c in parts.items()))

    return let(words(text), lambda ws: let(lines, lambda ls: of(ws, ls)))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """Adds the struct ``into``: STATS, base_failed, kept, and failed (the names of the method's rules that fail).

    Null and empty texts have no words, so they fail the base rule. Every row is judged alone: repeated rows
    get equal verdicts, an empty table gives an empty one, and other columns pass through untouched: where ``docs`` has a
    column ``into``, the verdict's name gets underscores in front and it is the last column.
    """

    def verdict(s: Column) -> Column:
        base = (s["n_words"] < 10) | (F.lit(100) * s["n_repeat_words"] > F.lit(20) * s["n_words"])
        failed = F.array_compact(F.array(*(F.when(~r.column(s), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
        return F.struct(*(s[k].alias(k) for k in STATS), base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"))

    (into,) = fresh(docs, into)
    return docs.withColumn(into, let(statistics(F.col(text)), verdict))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that all rules keep, with the columns of ``docs``."""
    (into,) = fresh(docs, "quality")
    return judge(docs, text, rules, into).where(F.col(into)["kept"]).drop(into)


def sql(source: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for doc_id, STATS, base_failed and kept."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    space = r"[ \t\n\r\f\v]"
    kept = " AND ".join(f"({r.sql()})" for r in rules) or "TRUE"
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM {source}),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS ws FROM t),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\r\f\v]')) AS ls FROM t),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
s AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop,
    CAST(len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS BIGINT) AS n_exclaimed,
    CAST(len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS BIGINT) AS n_ellipsis,
    CAST(len(list_filter(ls, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '• '))) AS BIGINT) AS n_bullets
  FROM t JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
SELECT *, (NOT base_failed AND {kept}) AS kept FROM b"""


def query(spark, sf_dir):
    """op8: doc_id, every statistic, base_failed and kept for each row of documents."""
    from corvane.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *(F.col("quality")[k].alias(k) for k in (*STATS, "base_failed", "kept")))
