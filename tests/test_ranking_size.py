import random

from papyra.operators import ranking


def test_texts_are_scored_together(monkeypatch):
    """Few calls of the kernel for many texts, whatever their lengths, and the scores of one text at a time."""
    rng, calls, kernel = random.Random(4), [], ranking.aligned
    texts = ["".join(rng.choice("aab c-(tß\0") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["ba" * 100_000]
    want = [ranking.subsequence_score(t, "abc") for t in texts]
    monkeypatch.setattr(ranking, "aligned", lambda hays, needle: calls.append(len(hays)) or kernel(hays, needle))
    assert ranking.subsequence_scores(texts, "abc") == want
    assert len(calls) < 10 and max(calls) * 40 <= ranking.CELLS


def test_sections_score_rows_once(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        title = rng.choice(["Blue wing", "big blue wall", "blue", "xblue w", "b l u e w", "Below us", "bellow", "bxxlxxuxxexxw", "none"])
        rows.append((f"k{i:03}", title, rng.choice("ABC"), [rng.choice(["blue w", "bw", ""])], rng.random() < 0.8, rng.randint(0, 3), i))
    for query in ("blue w", "bl", "blue"):
        candidates = spark.createDataFrame(rows, "key string, title string, group string, keywords array<string>, enabled boolean, uses long, at long")
        df = ranking.ranked_sections(candidates, query)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        scored = []
        for key, title, group, words, enabled, uses, _ in rows:
            s = ranking.match_score(title, words, query)
            if s is not None and (enabled or title.lower() == query):
                boost = min(40.0, ranking.np.log2(uses + 1.0) * 12) if uses else 0.0
                scored.append((group, s + boost if enabled else s - 10_000, title, key, enabled, title.lower().startswith(query)))
        floor = max(1.0, max((s for _, s, _, _, e, p in scored if e and not p), default=0.0) * ranking.WEAK)
        kept = sorted((-s, t.lower(), t.swapcase(), k, g) for g, s, t, k, e, p in scored if p or not e or s >= floor)
        groups = list(dict.fromkeys(r[4] for r in kept))
        want = [(n, g, i, r[3]) for n, g in enumerate(groups, 1) for i, r in enumerate([r for r in kept if r[4] == g][: ranking.PER_GROUP], 1)]
        assert [tuple(r)[:4] for r in df.orderBy("section", "rank").collect()] == want, query
