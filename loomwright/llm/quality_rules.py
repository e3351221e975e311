"""Quality rules with host-level verdicts, in DataFrame operations only.

Each document is measured by itself (array functions inside one row, no shuffle of texts) and judged by ``RULES``.
The failures of every rule are then counted per host. Per rule, a beta prior is fitted to the spread of the hosts'
rates (method of moments, weighted by size) and each host's rate is shrunk by it. A host is rejected by a rule

* if its shrunk rate is ``SURE`` or more: nearly all of it fails; or
* if its shrunk rate is ``MOST`` or more and stands apart from the rest: less two deviations of its own it is over the
  prior's mean and two deviations of the prior;

so that documents of hosts like all others, and clean documents of mixed hosts, stay. The verdicts go back to the
documents: a document is kept if it passes the base rules and no rule rejects its host.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows are
rows of their own; an empty table gives an empty table; other columns are carried by ``apply_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise, scratch

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SURE, MOST, APART = 0.9, 0.5, 2.0
MAX_STRENGTH = 1000.0
#: Failing rows go to every task up to this many (counted); beyond that texts are shuffled to their verdicts.
BROADCAST_ROWS = 1_000_000

# Fixed values: rules of documents, in SQL that Spark and DuckDB share. The first is the base verdict.
RULES = {
    "base": f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}


def _sorted_grams(words: Column) -> Column:
    """Three-word windows sorted by a 64-bit hash, with their starts: equal neighbours are repeated windows."""
    n = F.size(words)
    starts = F.when(n >= 4, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))  # noqa: E731
    return F.sort_array(F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.alias("p"))))


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    clean = F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, SPACE))
    return {"__text": text, "__words": words}


def document_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words and base_failed.
    Columns of ``docs`` with these names are replaced."""
    text = F.col("__text")
    step = docs.withColumns(measures(F.col(text_col)))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    squeezed = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    step = step.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(squeezed).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "__lines": lines,
            "__grams": _sorted_grams(F.col("__words")),
        }
    ).drop("__text", "__words")
    at = lambda i: F.get("__grams", i)["h"]  # noqa: E731
    doubled = F.filter("__grams", lambda g, i: (g["h"] == at(i + 1)) | ((i > 0) & (g["h"] == at(F.greatest(i - 1, F.lit(0))))))
    step = step.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__starts": F.sort_array(F.transform(doubled, lambda g: g["p"])),
        }
    ).drop("__lines", "__grams")
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    step = step.withColumn("n_repeat_words", covered.cast("long")).drop("__starts")
    return step.withColumn("base_failed", F.expr(RULES["base"]))


def host_verdicts(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """Per host: documents, its shrunk rate of the base rule, the rules that reject it (sorted) and whether any does.

    With n_i documents and a rule's rate r_i, m is the rate over all; the spread of the r_i beyond what chance gives,
    s = max(0, sum n_i (r_i - m)^2 - (H - 1) m (1 - m)) / (N - sum n_i^2 / N), gives the prior's strength
    m (1 - m) / s - 1, held between 1 and 1000."""
    sums = [F.sum(F.expr(rule).cast("long")).alias(f"bad_{name}") for name, rule in RULES.items()]
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").cast("double").alias("n"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"bad_{name}").cast("double").alias("bad")) for name in RULES]))
    # used for the priors and for the rates: a row per host and rule
    rates = materialise(hosts.select("host", "n", each.alias("x")).select("host", "n", "x.*"), "rates")
    every = rates.groupBy("rule").agg(
        F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").cast("double").alias("H"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("rr"),
    )  # fmt: skip
    m, n, k, p = F.col("m"), F.col("n"), F.col("k"), F.col("p")
    every = every.withColumn("m", F.col("B") / F.col("N"))
    spread = (F.col("rr") - F.col("N") * m * m - (F.col("H") - 1) * m * (1 - m)) / F.nullif(F.col("N") - F.col("nn") / F.col("N"), F.lit(0.0))
    strength = F.when(spread > 0, m * (1 - m) / spread - 1).otherwise(F.lit(MAX_STRENGTH))
    prior = every.select("rule", "m", F.greatest(F.lit(1.0), F.least(F.lit(MAX_STRENGTH), F.coalesce(strength, F.lit(MAX_STRENGTH)))).alias("k"))
    # the prior has a row per rule
    shrunk = rates.join(F.broadcast(prior), "rule").withColumn("p", (F.col("bad") + k * m) / (n + k))
    apart = p - APART * F.sqrt(p * (1 - p) / (n + k + 1)) > m + APART * F.sqrt(m * (1 - m) / (k + 1))
    shrunk = shrunk.withColumn("rejects", (p >= SURE) | ((p >= MOST) & apart))
    return shrunk.groupBy("host").agg(
        F.max("n").cast("long").alias("n"),
        F.max(F.when(F.col("rule") == "base", p)).alias("host_rate"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("rejects"), F.col("rule")))), ",").alias("host_rules"),
        F.max("rejects").alias("host_rejected"),
    )


def judge(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """Adds host_rate, host_rules and kept to measured rows. The hosts' table grows with the hosts, so the planner joins
    it by its size: a measured small one by broadcast, a large one by a join whose hot hosts Spark splits."""
    verdicts = materialise(host_verdicts(measured, host_col).withColumnRenamed("host", "__host").drop("n"), "verdicts")
    joined = measured.drop("host_rate", "host_rules", "host_rejected", "kept").join(verdicts, measured[host_col].eqNullSafe(verdicts["__host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("__host", "host_rejected")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row of ``docs``: its measures, base_failed, the host's rate, the rules that reject the host, and kept."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(host_col).alias(host_col), F.col(text_col).alias(text_col))
    measured = materialise(document_rules(rows, text_col).drop(text_col), "quality")
    return judge(measured, host_col)


def apply_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. Texts are measured once; the rows that go are
    found again by 128 bits of hash of host and text, which say all that the rules look at."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    keys = [F.xxhash64("host", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "host").alias("k2")]
    with scratch(docs.sparkSession) as tables:
        measured = document_rules(rows.select("host", "text", *keys), "text").drop("text")
        measured = materialise(measured, "quality")
        gone = tables.keep(judge(measured, "host").where("NOT kept").select("k1", "k2").distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.select("row", *keys).join(gone, ["k1", "k2"], "left_anti").select("row.*")


def oracle() -> str:
    """The same result as DuckDB SQL over the view ``documents``."""
    sums = " UNION ALL ".join(f"SELECT source, '{name}' AS rule, count(*)::DOUBLE AS n, sum(({rule})::INT)::DOUBLE AS bad FROM f GROUP BY source" for name, rule in RULES.items())
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text,'') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text,'{WORD}')) AS w, generate_subscripts(regexp_extract_all(text,'{WORD}'),1) AS p FROM d),
t AS (SELECT r, p, w, lead(w,1) OVER a AS x, lead(w,2) OVER a AS y FROM w WINDOW a AS (PARTITION BY r ORDER BY p)),
c AS (SELECT *, count(*) OVER (PARTITION BY r, w, x, y) AS k FROM t WHERE y IS NOT NULL),
u AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([p, p+1, p+2]) AS q FROM c WHERE k >= 2) GROUP BY r),
f AS (SELECT d.r, doc_id, source,
  len(regexp_extract_all(text,'{WORD}'))::BIGINT AS n_words,
  length(regexp_replace(text,'[ 	-]+','','g'))::BIGINT AS word_chars,
  length(regexp_replace(text,'[^#*$%&|<>]+','','g'))::BIGINT AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x,'[^ 	-]')))::BIGINT AS n_lines,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x,'[^ 	-]')))
   - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x,'[^ 	-]')))))::BIGINT AS n_dup_lines,
  coalesce(n,0)::BIGINT AS n_repeat_words FROM d LEFT JOIN u USING (r)),
h AS ({sums}),
e AS (SELECT rule, sum(n) AS N_, sum(bad) AS B_, count(*) AS H_, sum(n*n) AS nn, sum(bad*bad/n) AS rr FROM h GROUP BY rule),
s AS (SELECT *, B_/N_ AS m, (rr - N_*(B_/N_)*(B_/N_) - (H_-1)*(B_/N_)*(1-B_/N_)) / nullif(N_ - nn/N_, 0) AS spread FROM e),
k AS (SELECT rule, m, greatest(1.0, least({MAX_STRENGTH}, CASE WHEN spread > 0 THEN m*(1-m)/spread - 1 ELSE {MAX_STRENGTH} END)) AS k FROM s),
q AS (SELECT source, rule, n, m, k, (bad + k*m)/(n + k) AS p FROM h JOIN k USING (rule)),
v AS (SELECT source, max(CASE WHEN rule = 'base' THEN p END) AS host_rate,
  bool_or(p >= {SURE} OR (p >= {MOST} AND p - {APART}*sqrt(p*(1-p)/(n+k+1)) > m + {APART}*sqrt(m*(1-m)/(k+1)))) AS host_rejected FROM q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES["base"]}) AS base_failed,
  NOT ({RULES["base"]}) AND NOT host_rejected AS kept
FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source"""
