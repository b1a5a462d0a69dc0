import random

from pyspark.sql import functions as F

from kmerdex.llm import lm_score

from . import data
from .test_models import brute_lm


def test_rare_words_count_in_a_large_corpus(spark):
    rnd = random.Random(7)
    w = data.vocabulary(rnd, 200)
    rows = [(" ".join(rnd.choices(w, k=4000) + [f"once{i}"]), i < 20) for i in range(320)]  # more than 1,000,000 words
    docs = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(rows)], "doc_id long, text string, good boolean")
    got = {r["doc_id"]: r["difference"] for r in lm_score.score(docs, F.col("good")).collect()}
    want = dict(enumerate(brute_lm(rows, lm_score.MIX)))
    assert len(got) == 320 and all(abs(got[i] - want[i]) < 1e-9 for i in got)
