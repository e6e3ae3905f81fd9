"""Palette scores against a plain search over all alignments, and sections by their rules."""

import itertools
import random

import pytest

from papyra.operators import ranking


def plain(text, query):
    """Best score by trying every choice of positions."""
    if not query:
        return 0
    t, q = text.lower(), query.lower()
    if len(q) > len(t):
        return None
    if t.startswith(q):
        return 1000 + 200 / (1 + len(text))
    found = []
    for at in itertools.combinations(range(len(t)), len(q)):
        if all(t[i] == c for i, c in zip(at, q, strict=True)):
            total = -at[0]
            for k, i in enumerate(at):
                total += 8 + 60 * (i == 0 or t[i - 1] in " -&(")
                if k:
                    gap = i - at[k - 1]
                    total += 20 if gap == 1 else -6 - 2 * (gap - 2)
            found.append((total, at[-1] - at[0] + 1))
    if not found:
        return None
    top = max(s for s, _ in found)
    spans = {n for s, n in found if s == top}
    return top, spans


@pytest.mark.parametrize("seed", range(3))
def test_scores_are_the_best_of_all_alignments(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice("aab c-") for _ in range(rng.randint(0, 14)))
        query = "".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        want, got = plain(text, query), ranking.subsequence_score(text, query)
        if isinstance(want, tuple):
            assert got == want[0], (text, query)
        else:
            assert got == want, (text, query)


def test_matches_that_spread_too_far_are_none():
    assert ranking.subsequence_score("B. Proof of the Leading-Order Identification and Variance Collapse", "tool") is None
    assert ranking.subsequence_score("Select Tool", "tool") > ranking.subsequence_score("Stop the outer loop", "tool")
    assert ranking.subsequence_score("xa bcdefghijklmno p", "ap") is None
    assert ranking.subsequence_score("xab", "b") is not None


def test_keywords_count_less():
    assert ranking.match_score("Notes", ["export"], "export") == pytest.approx(999 * 0.6)
    assert ranking.match_score("Export", ["export"], "export") == 1000 + 200 / 7
    assert ranking.match_score("Notes", None, "zz") is None


def candidates(spark, rows):
    return spark.createDataFrame(rows, "key string, title string, group string, keywords array<string>, enabled boolean, uses long, at long")


def test_typed_sections(spark):
    rows = [(f"k{i}", t, g, [], e, u, i) for i, (t, g, e, u) in enumerate([
        ("Table of Contents", "Panels", True, 0), ("Next Tab", "Tabs", True, 0), ("New Tab", "Tabs", True, 5), ("Tab", "Tabs", False, 0), ("The average barrel", "Sections", True, 0), ("Stable", "View", True, 0),
    ])]
    got = ranking.ranked_sections(candidates(spark, rows), " tab ").orderBy("section", "rank").collect()
    names = [r.title for r in got]
    assert names[0] == "Table of Contents" and {"New Tab", "Next Tab"} <= set(names)
    assert names.index("New Tab") < names.index("Next Tab")
    assert next(r for r in got if r.title == "Tab").score < -8000
    assert ranking.ranked_sections(candidates(spark, rows), "  ").count() == 0
    many = [(f"k{i}", f"Tab {i}", "Tabs", [], True, 0, i) for i in range(30)]
    assert ranking.ranked_sections(candidates(spark, many), "tab").count() == 5


def test_usage_keeps_the_largest(spark):
    log = [(1, s, f"c{s % 70}") for s in range(140)] + [(1, 200, "c69"), (2, 1, "x")]
    got = {(r.owner, r.id): (r.uses, r["rank"]) for r in ranking.most_used(spark.createDataFrame(log, "owner long, seq long, id string"), "owner").collect()}
    counts = {}
    for _, s, c in sorted(x for x in log if x[0] == 1):
        counts[c] = counts.get(c, 0) + 1
        counts = dict(sorted(counts.items(), key=lambda x: -x[1])[:60])
    assert {c: n for (o, c), (n, _) in got.items() if o == 1} == counts and got[2, "x"] == (1, 1)
    assert ranking.most_used(spark.createDataFrame([], "owner long, seq long, id string"), "owner").count() == 0
