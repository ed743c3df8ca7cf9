"""A small set of cases that a working store answers, and their run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import MemoryLayer
from .operators import evaluation

#: (id, category, messages of the user, messages of another user, question, terms of each expected memory).
CASES = (
    ("city", "single_fact", ("I live in Lisbon",), (), "Which city does the user live in?", (("lisbon",),)),
    ("language", "single_fact", ("I use Fortran",), (), "Which language does the user use?", (("fortran",),)),
    ("city_moved", "update", ("I live in Lisbon", "I live in Porto"), (), "Where does the user live now?", (("porto",),)),
    ("name_changed", "update", ("my name is Ines", "my name is Inga"), (), "What is the user's name?", (("inga",),)),
    ("languages", "multi_value", ("I use Ada", "I use Forth"), (), "Which languages does the user use?", (("ada",), ("forth",))),
    ("city_and_name", "multi_fact", ("I live in Graz", "my name is Ute"), (), "What is the user's name and where do they live?", (("graz",), ("ute",))),
    ("story", "episodic", ("The ferry was late because of fog near the pier",), (), "Why was the ferry late?", (("ferry", "fog"),)),
    ("number", "identifier", ("Ticket ZX-81 is about the broken pump",), (), "What is ZX-81 about?", (("zx-81",),)),
    ("other_user", "isolation", ("I live in Ghent",), ("I live in Oslo",), "Which city does the user live in?", (("ghent",),)),
    ("spacing", "normalisation", ("I use   Prolog for puzzles",), (), "Does the user use Prolog?", (("PROLOG",),)),
)


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    """cases(case_id, category, user_id, query), messages as MemoryLayer.add takes them, expected(case_id, n, terms)."""
    cases, messages, expected = [], [], []
    for i, (case, category, mine, theirs, query, terms) in enumerate(CASES):
        cases.append((case, category, f"user-{case}", query))
        for k, (user, texts) in enumerate(((f"user-{case}", mine), (f"other-{case}", theirs))):
            messages += [(user, 2 * i + k, "user", t, n) for n, t in enumerate(texts)]
        expected += [(case, n, list(t)) for n, t in enumerate(terms)]
    return {
        "cases": spark.createDataFrame(cases, "case_id string, category string, user_id string, query string"),
        "messages": spark.createDataFrame(messages, "user_id string, conv_id long, role string, content string, n long"),
        "expected": spark.createDataFrame(expected, "case_id string, n int, terms array<string>"),
    }


def run(spark: SparkSession, folder: str, k: int = 5) -> DataFrame:
    """Adds the cases' messages to a new store, asks all questions in one search and gives the metrics of each case."""
    f, layer = frames(spark), MemoryLayer(spark, folder)
    layer.add(f["messages"]).count()
    numbered = f["cases"].withColumn("qid", F.xxhash64("case_id"))
    hits = layer.search(numbered.select(F.col("user_id").alias("scope"), "qid", F.col("query").alias("text")), limit=k)
    memories = layer.memories().select("id", "text", F.col("scope").alias("owner"), "is_active")
    found = hits.join(numbered.select("qid", "case_id"), "qid").join(memories, "id").select("case_id", "rank", "text", "owner", "is_active")
    return evaluation.case_metrics(f["cases"].select("case_id", "user_id"), found, f["expected"])
