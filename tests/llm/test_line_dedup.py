"""Line dedup against a plain version of its contract."""

import hashlib
import random

import corpus
import pytest
from pyspark.sql import functions as F

from papyra.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOW)


def plain(docs):
    """Rows (doc_id, n_lines, n_dropped, kept) of rows (doc_id, text, ..); a null id is the smallest."""
    holders = {}
    for i, text, *_ in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    out = []
    for i, text, *_ in docs:
        own, lines = -(2**63) if i is None else i, (text or "").split("\n")
        stay = [x for x in lines if not (len(h := holders.get(key(x), ())) >= 3 and own != max(h))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def judged(spark, docs, parts=3, **options):
    df = spark.createDataFrame(corpus.rows(docs), corpus.SCHEMA).repartition(parts)
    rows = dedup_lines(df, **options).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 9, "fanout": 2}])
def test_equals_the_plain_version(spark, options):
    rng = random.Random(5)
    pool = [corpus.words(rng, 6) for _ in range(12)] + ["short", "x" * 19, "y" * 20, "É" * 20, "é" * 20]
    docs = [(rng.choice([None, *range(40)]), "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([p, p.upper()]) for p in rng.choices(pool, k=rng.randint(1, 9))), None, None) for _ in range(90)]
    docs = list({d[0]: d for d in docs}.values()) + corpus.edge_documents()
    assert judged(spark, docs, **options) == sorted(plain(docs), key=str)


def test_empty_table(spark):
    assert judged(spark, [], 1) == []


def test_columns_stay_with_their_row(spark):
    docs = corpus.edge_documents()
    out = dedup_lines(spark.createDataFrame(corpus.rows(docs), corpus.SCHEMA))
    assert out.select("row.*").columns == [c.split()[0] for c in corpus.SCHEMA.split(", ")]
    sums = out.select(F.sha2("kept", 256).alias("h"), "kept").collect()
    assert all(r.h == hashlib.sha256(r.kept.encode()).hexdigest() for r in sums)
