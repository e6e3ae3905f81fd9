"""Small seeded inputs that several tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, row int, size string, node long, items string, kept double, part int"
CLASH = ("x", 7, None, 3, "i", 1.5, 9)


def rows(docs):
    """(doc_id, text, lang, source) to rows of SCHEMA, whose last columns have names that operators use themselves."""
    return [(i, t, lang, s, None if t is None else len(t), *CLASH) for i, t, lang, s in docs]


def words(rng, n, letters="abcdefghijklmnop"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))][0]


def edge_documents():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    shared = "this line is shared by several documents"
    docs = [
        (None, None, None, None), (None, None, None, None), (None, "", None, "a"), (1, "", "en", None), (2, None, "de", "b"),
        (3, words(rng, 60_000), "en", "a"), (4, "x" * 400_000, "en", "a"), (5, "\n" * 50, None, "b"), (6, " \t\r\n\x0b\x0c", "en", "b"),
        (7, "1234 5678 !!", "en", "c"), (8, "é ß ﬁ İ Ω 中文 \U0001f600  \x85￾", None, "é"),
    ]
    for i in range(10, 16):
        docs.append((i, f"{words(rng, 30)}\n{shared}\n  {shared.upper()} \n{words(rng, 20)}", "en", "a"))
    docs += [docs[-1], docs[-1], (15, docs[-2][1], "de", "b")]
    return docs
