from papyra.functions import text as tx
from papyra.functions.formats import script_segments
from papyra.functions.validate import clean_url


def test_normalize():
    assert tx.normalize("hello \t\n  world")[0] == "hello world"
    assert tx.normalize("it’s “fine”")[0] == "it's \"fine\""
    assert tx.normalize("ﬁle")[0] == "file"


def test_matches_map_back_to_raw_text():
    assert [m[:2] for m in tx.matches("hello   \n world", tx.prepare_query("hello world"))] == [(0, 15)]
    assert [m[:2] for m in tx.matches("my ﬁle here", "file")] == [(3, 3)]
    assert [m[0] for m in tx.matches("The Quick brown the END", "the")] == [0, 16]


def test_script_segments():
    assert script_segments("x^2") == [("x", "normal"), ("2", "super")]
    assert script_segments("a_{ij") == [("a_{ij", "normal")]


def test_urls():
    assert clean_url("javascript:alert(1)") is None
    assert clean_url(" HTTPS://Example.com ") == "https://example.com/"
