"""Folds over a page's characters and lines: the cases that windows alone would get wrong."""

from papyra.operators import structure


def folded(fold, rows):
    out = []
    for r in rows:
        out += list(fold.step(r))
    return out + list(fold.finish())


def chars(text, x=0.0, y=100.0, w=6.0, h=9.0, size=10.0, at=0, math=False):
    return [{"at": at + i, "ch": c, "x": x + i * w, "y": y, "w": 0.0 if c in " \n" else w, "h": 0.0 if c in " \n" else h, "size": size, "math": math} for i, c in enumerate(text)]


def test_runs_end_at_gaps_drifts_lines_and_steps_back():
    near = chars("ab", h=10.0) + chars("cd", x=17.9, h=10.0, at=2)
    assert [r[1] for r in folded(structure.Runs(), near)] == ["abcd"]
    assert [r[1] for r in folded(structure.Runs(), chars("ab", h=10.0) + chars("cd", x=18.1, h=10.0, at=2))] == ["ab", "cd"]
    assert [r[1] for r in folded(structure.Runs(), chars("ab") + chars("cd", x=12.0, y=106.0, at=2))] == ["ab", "cd"]
    assert [r[1] for r in folded(structure.Runs(), chars("ab\ncd"))] == ["ab", "cd"]
    assert [r[1] for r in folded(structure.Runs(), chars("abcdefgh") + chars("z", x=0.0, at=8))] == ["abcdefgh", "z"]
    # the run's box grows: a tall letter first lets later ones drift further
    assert [r[1] for r in folded(structure.Runs(), chars("A", h=20.0) + chars("b", x=6.0, y=108.0, h=8.0, at=1))] == ["Ab"]
    assert folded(structure.Runs(), chars("  ")) == [] and folded(structure.Runs(), []) == []


def test_lines_go_by_baselines_and_restore_scripts():
    row = chars("L") + chars("2", x=6.0, y=103.6, h=6.0, size=7.0, at=1) + chars("x", x=30.0, at=2)
    row[1]["ch"], lines = "2", folded(structure.Lines(), [row[0], {**row[1], "at": 1, "ch": "\n", "w": 0.0, "h": 0.0}, row[1], row[2]])
    assert [line[1] for line in lines] == ["L^2x"]
    gap = [*chars("S"), *chars("\n", at=1), *chars("u", x=12.0, at=2)]
    assert folded(structure.Lines(), gap)[0][1] == "S u"
    assert [line[1] for line in folded(structure.Lines(), chars("one") + chars("two", y=85.0, at=3))] == ["one", "two"]
    assert folded(structure.Lines(), chars("abx") + chars("-1", x=18.0, y=104.0, h=5.0, size=6.0, at=3, math=True))[0][1] == "abx^{-1}"
    assert folded(structure.Lines(), chars("x") + chars("-", x=6.0, y=104.0, h=2.0, size=6.0, at=1))[0][1] == "x-"
    assert folded(structure.Lines(), chars("corrup\x02"))[0][1] == "corrup-" and folded(structure.Lines(), chars("a\x02b"))[0][1] == "ab"


def test_body_size_is_the_mode_within_a_hair():
    assert structure.body_size([10.0, 10.02, 10.04, 7.0, 7.0]) == 10.0 and structure.body_size([0.0]) == 0.0 and structure.body_size([8.0, 9.0]) == 8.0


def run(text, x=0.0, y=100.0, w=50.0, h=10.0, page=0):
    return {"text": text, "x": x, "y": y, "w": w, "h": h, "page": page, "median": 10.0}


def prose(*runs):
    return folded(structure.Prose(), runs)[0][0]


def test_prose():
    assert prose(run("state-"), run("ment", y=88.0)) == "statement" and prose(run("state-"), run("Of", y=88.0)) == "state- Of"
    assert prose(run("end."), run("New", y=70.0)) == "end.\n\nNew" and prose(run("end."), run("Indented", x=7.0, y=88.0)) == "end.\n\nIndented"
    assert prose(run("word"), run("2", x=50.0, y=106.0, w=5.0)) == "word2" and prose(run("a"), run("b", x=53.0)) == "a b"
    assert prose(run("column"), run("next", x=200.0, y=700.0)) == "column next" and prose(run("page"), run("two", page=1)) == "page two"
    assert prose(run("so­ft  and\tgap")) == "soft and gap" and prose() == ""


def line(text, y, x=10.0, label=None, rest=None, start=0):
    return {"start": start, "text": text, "x": x, "y": y, "height": 10.0, "label": label, "rest": rest}


def test_captions():
    found = lambda *lines: [(r[1], r[2]) for r in folded(structure.Captions(), lines)]
    first = line("Figure 1. A", 100.0, label="Figure 1", rest="A long-")
    assert found(first, line("er title", 88.0)) == [("Figure 1", "A longer title")]
    assert found(first, line("far below", 70.0)) == [("Figure 1", "A long-")] and found(first, line("other column", 88.0, x=200.0)) == [("Figure 1", "A long-")]
    assert found(first, line("Table 2", 88.0, label="Table 2", rest="B")) == [("Figure 1", "A long-"), ("Table 2", "B")]
    long = line("x", 100.0, label="Figure 1", rest="word " * 40)
    assert len(found(long)[0][1]) <= 141 and found(long)[0][1].endswith("word…")


def test_structure_shows_headings_only_with_environments():
    e = lambda i, heading, depth=0: {"id": i, "heading": heading, "depth": depth, "page": 0, "y": -i}
    got = folded(structure.Merged(), [e(1, True), e(2, True), e(3, False), e(4, True, 1), e(5, False), e(6, False), e(7, True), e(8, False), e(9, True)])
    assert got == [(2, True, 0), (3, False, 1), (4, True, 1), (5, False, 2), (6, False, 2), (7, True, 0), (8, False, 1)]


def test_match_rectangles_merge_on_a_line():
    rows = chars("abc") + chars("de", y=80.0, at=3)
    assert folded(structure.Rects(), rows) == [(0.0, 100.0, 18.0, 9.0), (0.0, 80.0, 12.0, 9.0)]


def test_runaway_links(spark):
    def kept(rows):
        df = spark.createDataFrame([(1, i, "http://site.example/path", 0.0, 30.0 * i, w, 10.0, 700.0, t) for i, (w, t) in enumerate(rows)] + [(1, 99, None, 0.0, 0.0, 1.0, 1.0, 700.0, "x")], "page int, rect int, uri string, x double, y double, w double, h double, page_h double, text string")
        return sorted(r.rect for r in structure.without_runaways(df, "page").collect())

    assert kept([(50.0, "prose")] * 11) == [*range(11), 99]
    assert kept([(50.0, "site.example")] * 2 + [(50.0, "prose!")] * 12) == [0, 1, 99]
    assert kept([(50.0, "prose!")] * 5 + [(9.0, "click here")] + [(50.0, "prose!")] * 8) == [5, 99]
    assert kept([(50.0, "")] * 14) == [*range(14), 99]


def test_preview_crop_stops_at_a_gap(spark):
    pages = spark.createDataFrame([(1, 600.0, 800.0, 700.0, 50.0, 300.0), (2, 600.0, 800.0, None, 50.0, 300.0)], "page int, page_w double, page_h double, ay double, low double, high double")
    runs = spark.createDataFrame([(1, 60.0, 700.0 - 12 * k, 100.0, 10.0) for k in range(10)] + [(1, 60.0, 500.0, 100.0, 10.0), (1, 400.0, 560.0, 100.0, 10.0)], "page int, x double, y double, w double, h double")
    rows = {r.page: r for r in structure.preview_crops(pages, runs, "page").collect()}
    assert (rows[1].x, rows[1].y, rows[1].y + rows[1].h) == (46.0, 588.0, 734.0)
    assert rows[2].y == 706.0


def test_folds_take_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, i, "a", 6.0 * i, 0.0, 6.0, 9.0) for i in range(3)], "page int, at long, ch string, x double, y double, w double, h double")
    assert [r.text for r in structure.text_runs(df, ["page"]).collect()] == ["aaa"] and structure.text_runs(df.limit(0), ["page"]).count() == 0
