"""Markup whose end tags are left out."""

from graphquarry.llm import htmlblocks


def blocks(html):
    return [t for _, t, _ in htmlblocks.leaf_blocks(html)]


def test_a_head_without_end_tag():
    for body in ("<body><article><p>one", "<article><p>one", "<p>one", "<img src=x><p>one"):
        assert blocks(f"<html><head><title>T</title><meta name=x>{body}</p></article>") == ["one"]
    assert blocks("<html><head><title>T</title><script>x</script></head><body><p>one") == ["one"]
    assert blocks("<html><head><noscript><p>no</p></noscript><title>T</title><body><p>one") == ["one"]


def test_controls_that_are_never_closed():
    assert blocks("<div><button>press<p>one</p><p>two</div>") == ["one", "two"]
    assert blocks("<div><p>a <audio src=x>none<p>one</div>") == ["a", "one"]
    assert blocks("<select><option>1<option>2</select><p>one") == ["one"]
    assert blocks("<div><object data=x><b>none<h2>one</h2></div>") == ["one"]
    assert blocks("<div><button>press<p>one</p></div><button>go</button><p>two") == ["one", "two"]


def test_fallback_content_stays_hidden():
    assert blocks("<video src=x><p>no video here</p></video><p>one") == ["one"]
    assert blocks("<object><object><p>no</p></object><p>no</p></object><p>one") == ["one"]
