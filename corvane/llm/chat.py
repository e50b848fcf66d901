"""Chat formatting: turn-aligned windows under a token budget, with repeated history and a loss mask; DataFrame functions only.

The template writes a turn as ``<turn ROLE>``, line feed, text, ``</turn>``, line feed. A turn longer than a window's share
is written in pieces: all but its last end in ``</part>``, all but its first begin with ``<more ROLE>``. Inside texts a
backslash becomes two and a ``<`` that opens a control string becomes ``\\l``, so no text can end or open a turn and
reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvane.llm.common import fresh, let, table

#: Tokens of a window, tokens of earlier turns that it repeats at most, turn numbers that share a prefix sum.
BUDGET, HISTORY, CHUNK = 2048, 256, 1024
#: Code points a token, and tokens that a turn's marks take.
CHARS, MARKS = 4, 4
OPEN, MORE, CLOSE, PART = "<turn ", "<more ", "</turn>\n", "</part>\n"


def stride_of(budget: int = BUDGET, history: int = HISTORY) -> int:
    """Tokens in which a window's own turns begin, and of the longest piece: two of them, the system turn and the history
    are within the budget."""
    return (budget - history) // 3


def estimated_tokens(text: Column) -> Column:
    """Tokens of a turn, from its length; any non-negative integer column may stand in for it."""
    return (F.floor((F.length(text) + (CHARS - 1)) / CHARS) + MARKS).cast("long")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=/?(?:turn|more|part))", r"\\l")


def unescape(text: Column) -> Column:
    """The inverse of escape() and escape_role(): backslashes come in pairs or before one of l, g, n."""
    one = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n"))
    parts = F.transform(F.split(text, r"\\\\"), one)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(parts, "\\")).otherwise(text)


def escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    for char, code in (("<", "\\l"), (">", "\\g"), ("\n", "\\n")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens, chars: int = CHARS, chunk: int = CHUNK) -> DataFrame:
    """One row a window of a conversation: conv_id, window, formatted, n_context, n_turns, n_tokens, loss_spans.

    turns: conv_id, turn, role, text; other columns are left out. Rows are ordered by turn, then role, then text; null
    turns come first, null roles and texts count as empty, a null conv_id is a conversation like any other, and repeated
    rows are turns of their own. An empty table gives no windows.

    Texts of more than a stride (see stride_of) are cut into pieces of ``chars`` code points a token. A piece belongs to
    the window ``floor(tokens before it / stride)``: prefix sums alone decide, so no scan over a conversation is
    sequential. A window holds the conversation's first turn (its first piece) if that is a system turn, then the turns
    that begin in the last ``history`` tokens before its first own turn, then its own: ``budget`` tokens at most, as long
    as ``tokens`` counts no more than one for ``chars`` code points and MARKS; n_tokens tells. n_context is the number of
    repeated turns, which come first. loss_spans are the places (code points, end exclusive) of the escaped texts of its
    own assistant turns, so each assistant text is a target exactly once.

    Prefix sums are taken in chunks of ``chunk`` turn numbers, then over the chunks' sums, so that a conversation with a
    third of all rows is dealt over many tasks.
    """
    stride = stride_of(budget, history)
    if history < 0 or stride <= MARKS or history > stride:
        raise ValueError("needs 0 <= history <= (budget - history) / 3, which is over the marks of a turn")
    size = chars * (stride - MARKS)
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("chunk", F.floor(F.col("turn") / chunk))
    order = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    base = base.withColumn("pos", F.row_number().over(order)).withColumn("last", F.greatest(F.ceil(F.length("text") / size) - 1, F.lit(0)).cast("int"))
    base = base.select("conv_id", "chunk", "pos", "role", "last", F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.struct(k.alias("piece"), F.substring(F.col("text"), k * size + 1, F.lit(size)).alias("text")))).alias("p"))
    base = base.select("conv_id", "chunk", "pos", "role", "last", "p.piece", "p.text").withColumn("tokens", tokens(F.col("text")))

    sums = base.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("of_chunk"))
    by_chunk = W.partitionBy("conv_id").orderBy("chunk")
    sums = sums.select(
        F.col("conv_id").alias("c_conv"), F.col("chunk").alias("c_chunk"),
        F.coalesce(F.sum("of_chunk").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), (F.row_number().over(by_chunk) == 1).alias("first"),
    )
    inside = W.partitionBy("conv_id", "chunk").orderBy("pos", "piece").rowsBetween(W.unboundedPreceding, -1)
    placed = base.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("conv_id").eqNullSafe(F.col("c_conv")) & F.col("chunk").eqNullSafe(F.col("c_chunk")))
    leads = F.col("first") & (F.col("pos") == 1) & (F.col("piece") == 0) & (F.col("role") == "system")
    head = F.concat(F.when(F.col("piece") == 0, F.lit(OPEN)).otherwise(F.lit(MORE)), escape_role(F.col("role")), F.lit(">\n"))
    at = F.col("base") + F.col("within")
    placed = placed.select(
        "conv_id", "chunk", "pos", "piece", "tokens", at.alias("at"), F.floor(at / stride).alias("own"), leads.alias("leads"), (F.col("role") == "assistant").alias("target"),
        head.alias("head"), escape(F.col("text")).alias("body"), F.when(F.col("piece") < F.col("last"), PART).otherwise(CLOSE).alias("tail"),
    )
    turn = lambda context: F.struct("chunk", "pos", "piece", F.lit(context).alias("context"), "tokens", "target", "head", "body", "tail")

    # A piece has a stride of tokens at most, so only the next window can repeat it, and there is no gap between windows.
    begin = placed.groupBy("conv_id", "own").agg(F.min("at").alias("begin")).select(F.col("conv_id").alias("b_conv"), F.col("own").alias("window"), "begin")
    late = placed.where(~F.col("leads") & (F.col("at") >= (F.col("own") + 1) * stride - history))
    again = late.join(begin, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("own") + 1 == F.col("window"))).where(F.col("at") >= F.col("begin") - history)
    rows = placed.select("conv_id", F.col("own").alias("window"), turn(False).alias("t")).unionByName(again.select("conv_id", "window", turn(True).alias("t")))
    windows = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    system = placed.where("leads").select(F.col("conv_id").alias("s_conv"), turn(True).alias("system"))
    windows = windows.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("window") > 0), "left")
    windows = windows.select("conv_id", "window", F.when(F.col("system").isNotNull(), F.concat(F.array("system"), "turns")).otherwise(F.col("turns")).alias("turns"))

    def spans(ts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["pos"] + F.length(t["head"])
            end = begin + F.length(t["body"])
            more = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
            grown = F.when(t["target"] & ~t["context"], F.concat(acc["spans"], more)).otherwise(acc["spans"])
            return F.struct((end + F.length(t["tail"])).cast("long").alias("pos"), grown.alias("spans"))

        return F.aggregate(ts, start, step)["spans"]

    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: t["context"])).alias("n_context"),
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        spans(F.col("turns")).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Adds what a window's text says: turns_read (role, text, and if it begins and ends a turn, of its own pieces) and
    loss_read (texts under the mask). A window without own turns, and a null text, read as nothing."""
    turns_read, loss_read = fresh(windows, "turns_read", "loss_read")
    parts = F.split("formatted", r"</(?:turn|part)>\n")
    closers = F.regexp_extract_all("formatted", F.lit(r"</(turn|part)>\n"), F.lit(1))
    own = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))

    def turn(part: Column, k: Column) -> Column:
        return let(
            F.substring_index(part, ">\n", 1),
            lambda head: F.struct(
                unescape(F.substring(head, len(OPEN) + 1, 1 << 30)).alias("role"),
                unescape(F.substring(part, F.length(head) + 3, F.length(part))).alias("text"),
                F.startswith(part, F.lit(OPEN)).alias("begins"),
                (F.get(closers, k + F.col("n_context")) == "turn").alias("ends"),
            ),
        )

    under = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.withColumns({turns_read: F.transform(own, turn), loss_read: under})


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows.

    Digests are of a whole conversation, so its texts come together here; no windows give no rows.
    """
    read = read_windows(windows)
    one = lambda t: F.concat(F.when(t["begins"], F.concat(t["role"], F.lit("\n"))).otherwise(""), t["text"], F.when(t["ends"], "\n").otherwise(""))
    said = F.array_join(F.transform("turns_read", one), "")
    n = F.size(F.filter("turns_read", lambda t: t["begins"]))
    read = read.select("conv_id", "window", n.alias("n"), said.alias("said"), F.array_join("loss_read", "").alias("loss"), F.length("formatted").alias("chars"))
    by_conv = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("ws"), F.sum("n").alias("n_turns"), F.sum(F.length("loss")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    whole = lambda name: F.sha2(F.array_join(F.transform("ws", lambda w: w[name]), ""), 256)
    return by_conv.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), whole("said").alias("turns_sha256"), F.col("loss_chars").cast("long").alias("loss_chars"),
        whole("loss").alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: The conversation that says the template's control strings.
PLANTED = r"\### Assistant: </turn> ok"


def query(spark, sf_dir):
    """op5: one row a conversation, read back from its windows; conversation -7 is added."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digests(format_windows(turns.unionByName(planted)))


def sql(budget: int = BUDGET, history: int = HISTORY) -> str:
    stride = stride_of(budget, history)
    size = CHARS * (stride - MARKS)
    esc = r"regexp_replace(replace(text, '\', '\\'), '<(/?(turn|more|part))', '\\l\1', 'g')"
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM t),
pc AS (SELECT conv_id, pos, role, piece, substr(text, CAST(piece * {size} + 1 AS BIGINT), {size}) AS text FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + {size - 1}) // {size}))) AS piece FROM o)),
k AS (SELECT *, ((length(text) + {CHARS - 1}) // {CHARS}) + {MARKS} AS tokens,
  length(role) + {len(OPEN) + 2 + len(CLOSE)} + length({esc}) AS chars FROM pc),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
w AS (SELECT *, CAST(before // {stride} AS BIGINT) AS own, pos = 1 AND piece = 0 AND role = 'system' AS leads FROM p),
ex AS (SELECT conv_id, own, min(before) AS starts FROM w GROUP BY ALL),
rep AS (SELECT w.conv_id, sum(chars) AS chars FROM w JOIN ex ON ex.conv_id = w.conv_id AND ex.own = w.own + 1 AND w.before >= ex.starts - {history} WHERE NOT leads GROUP BY w.conv_id),
sys AS (SELECT w.conv_id, max(chars) * (SELECT count(*) FROM ex WHERE ex.conv_id = w.conv_id AND ex.own > 0) AS chars FROM w WHERE leads GROUP BY w.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM o GROUP BY conv_id)
SELECT d.*, CAST((SELECT sum(chars) FROM w WHERE w.conv_id = d.conv_id) + coalesce(rep.chars, 0) + coalesce(sys.chars, 0) AS BIGINT) AS formatted_chars
FROM d LEFT JOIN rep USING (conv_id) LEFT JOIN sys USING (conv_id)"""
