"""Golden sets: reading, and generating questions from documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions.text import middle_words, raw_sentences, squeeze, strip_inline_markdown

# Verbs by which a sentence becomes a question, first match wins; words that no question is about.
TEMPLATES = [
    (r"\s+defaults?\s+to\s+.+?[.?!]?$", "what does ", " default to?"),
    (r"\s+is\s+(?:the\s+)?.{5,}?[.?!]?$", "what is ", "?"),
    (r"\s+are\s+.{5,}?[.?!]?$", "what are ", "?"),
    (r"\s+(?:means|refers\s+to)\s+.+?[.?!]?$", "what does ", " mean?"),
    (r"\s+(?:combines|uses|requires|supports|provides|returns|produces|prevents|allows|handles)\s+.+?[.?!]?$", "what does ", " do?"),
    (r"\s+(?:can|must|should)\s+(?!not\b).+?[.?!]?$", "what can ", " do?"),
]
CONNECTIVE = r"(?i)^(?:so|and|but|then|thus|therefore|however|also|that|this|it|which|these|those)\b"
CLAUSE = (
    r"(?i)(?:,|;|:|\b(?:and|or|but|so|because|which|that|while|when|where|than|if|since|until|before|after|unless|though|although|whereas|whether|as)\b"
    r"|\b(?:is|are|was|were|be|been|being|has|have|had|can|cannot|could|will|would|shall|should|must|may|might|do|does|did)\b)"
)
VAGUE = "there it this that they them these those what which here one some none each both everything anything something nothing".split()
VAGUE_PHRASES = ["the following", "the above", "the result", "the point"]
SHORTEST, LONGEST = 45, 300


def usable_subject(subject: Column) -> Column:
    """Whether a subject is something a person could ask about."""
    bare = F.trim(F.regexp_replace(F.lower(subject), r"^(?:the|a|an)\s+", ""))
    vague = bare.isin(*VAGUE, *VAGUE_PHRASES) | F.lower(subject).isin(*VAGUE, *VAGUE_PHRASES) | F.split(bare, r"\s+")[0].isin(*VAGUE)
    return F.length(subject).between(5, 70) & (F.size(F.split(subject, r"\s+")) <= 8) & ~subject.rlike(CONNECTIVE) & ~subject.rlike(CLAUSE) & ~vague & subject.rlike(r"\p{L}")


def question(sentence: Column) -> Column:
    """A question that the sentence answers; null if it makes none."""
    out = []
    for verb, before, after in TEMPLATES:
        subject = F.regexp_replace(F.trim(F.regexp_extract(sentence, f"(?i)^(.{{5,80}}?){verb}", 1)), ",+$", "")
        lowered = F.concat(F.lower(F.left(subject, F.lit(1))), F.substring(subject, F.lit(2), F.length(subject)))
        out.append(F.when((subject != "") & usable_subject(subject), F.concat(F.lit(before), lowered, F.lit(after))))
    return F.coalesce(*out)


def generate(docs: DataFrame, per_document: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, idx, question, must_contain: the first questions of each document, each question once in the corpus (by
    the smallest document)."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(raw_sentences(F.col(text_col))).alias("idx", "raw"))
    rows = rows.withColumn("raw", squeeze(F.col("raw"))).where(~F.col("raw").rlike(r"^(\||```|-|\*|#|>)"))
    rows = rows.withColumn("s", strip_inline_markdown(F.col("raw"))).where(F.length("s").between(SHORTEST, LONGEST) & ~F.col("s").rlike(CONNECTIVE))
    rows = rows.select("doc", "idx", question(F.col("s")).alias("question"), middle_words(F.col("s")).alias("must_contain")).where("question IS NOT NULL")
    first = rows.groupBy(F.lower("question").alias("key")).agg(F.min_by(F.struct("doc", "idx", "question", "must_contain"), F.struct("doc", "idx")).alias("r")).select("r.*")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("idx"))
    return first.withColumn("nth", nth).where(F.col("nth") <= per_document).drop("nth")


#: A golden set's columns besides id and query; a list that is left out is empty.
LISTS = {"must_contain": "array<string>", "chunk_ids": "array<string>", "document_ids": "array<string>", "document_titles": "array<string>", "tags": "array<string>", "grades": "map<string,int>"}


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set from YAML, JSON (a list, or an object with ``queries``) or JSON lines: id, query, the expectations
    (chunk_ids, document_ids, document_titles, must_contain), grades and tags. Ids that occur twice fail; a missing id
    comes from the query."""
    if path.endswith((".yaml", ".yml")):
        import yaml  # only where it is installed

        # a golden set is written by hand: it fits on the driver
        text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        found = yaml.safe_load(text)
        lines = [json.dumps(q, ensure_ascii=False) for q in (found["queries"] if isinstance(found, dict) else found)]
        rows = _parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    else:
        rows = spark.read.option("multiLine", path.endswith(".json")).json(path)
        if "queries" in rows.columns:
            rows = rows.select(F.explode("queries").alias("q")).select("q.*")
        rows = _parsed(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("a golden set with the same id twice")
    return rows


def _parsed(lines: DataFrame) -> DataFrame:
    """Questions from one JSON object a row."""
    kinds = ", ".join(["id string", "query string", *(f"{n} {k}" for n, k in LISTS.items())])
    rows = lines.select(F.from_json("value", kinds).alias("q")).select("q.*")
    rows = rows.withColumn("id", F.coalesce("id", F.left(F.sha2("query", 256), F.lit(12))))
    return rows.select("id", "query", *[F.coalesce(n, (F.create_map() if k.startswith("map") else F.array()).cast(k)).alias(n) for n, k in LISTS.items()])


def save_golden(golden: DataFrame, path: str, name: str = "golden") -> None:
    """A golden set as a file of the kind that its name says: .yaml, .json or .jsonl."""
    rows = [{k: v for k, v in r.asDict().items() if v} for r in golden.select("id", "query", *[c for c in LISTS if c in golden.columns]).orderBy("id").toLocalIterator()]
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = yaml.safe_dump({"name": name, "queries": rows}, allow_unicode=True, sort_keys=False)
    elif path.endswith(".json"):
        text = json.dumps({"name": name, "queries": rows}, ensure_ascii=False, indent=2)
    else:
        text = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def from_pairs(pairs: DataFrame) -> DataFrame:
    """A golden set from (query, chunk_id) pairs: a question a query, with all its chunks."""
    rows = pairs.groupBy("query").agg(F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))).alias("chunk_ids"))
    return _parsed(rows.select(F.to_json(F.struct("query", "chunk_ids")).alias("value")))


def mined(log: DataFrame, least: int = 2) -> DataFrame:
    """A golden set from a retrieval log (query, chunk_id, rank): queries asked ``least`` times or more, with the chunks
    that most often came first (all of equals)."""
    tops = log.where("rank = 1").groupBy("query", "chunk_id").agg(F.count("*").alias("n"))
    asked = Window.partitionBy("query")
    tops = tops.withColumns({"asked": F.sum("n").over(asked), "most": F.max("n").over(asked)})
    return from_pairs(tops.where((F.col("asked") >= least) & (F.col("n") == F.col("most"))).select("query", "chunk_id"))


def tagged(golden: DataFrame, tag: str) -> DataFrame:
    return golden.where(F.array_contains("tags", tag))


def all_tags(golden: DataFrame) -> DataFrame:
    return golden.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")
