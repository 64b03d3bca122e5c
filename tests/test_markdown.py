import time

import pytest

from mdlake.functions import frontmatter as FM, markdown as M
from mdlake.operators.parse import parse_one

SAMPLE = """---
title: A Sample
tags: [one, two]
category: notes
---
# Heading

A paragraph with [a link](https://example.org/x) and ![a picture](pic.png).

## Second

```rust linenos
fn main() {}
```

- one
- two with [[other-page]]
- three

> A quote with [more](more.md).

---

See [[guide|the guide]].
"""


def kinds(text):
    return [b["block_type"] for b in parse_one(text)["blocks"]]


def links(text):
    return [(x["link_type"], x["target"], x["anchor_text"]) for x in parse_one(text)["links"]]


def test_sample():
    r = parse_one(SAMPLE)
    assert r["title"] == "A Sample"
    assert kinds(SAMPLE) == ["heading", "paragraph", "heading", "code_block", "list", *["list_item", "paragraph"] * 3, "block_quote", "paragraph", "thematic_break", "paragraph"]
    assert [b["ordinal"] for b in r["blocks"]] == list(range(len(r["blocks"])))
    assert links(SAMPLE) == [
        ("markdown_link", "https://example.org/x", "a link"), ("image_link", "pic.png", "a picture"), ("markdown_link", "more.md", "more"),
        ("wiki_link", "other-page", "other-page"), ("wiki_link", "guide", "the guide"),
    ]
    assert [(t["key"], t["value"]) for t in r["tags"]] == [("category", '"notes"'), ("tags", '"one"'), ("tags", '"two"'), ("title", '"A Sample"')]
    code = r["blocks"][3]
    assert (code["language"], code["text_content"], code["raw_markdown"]) == ("rust", "fn main() {}\n", "```rust linenos\nfn main() {}\n```")
    assert [b["depth"] for b in r["blocks"]] == [0, 0, 0, 0, 0, 1, 2, 1, 2, 1, 2, 0, 1, 0, 0]
    assert r["blocks"][4]["text_content"] == "onetwo with [[other-page]]three"


@pytest.mark.parametrize(
    "text, matter, body",
    [
        ("---\na: 1\n---\nx", "a: 1\n", "x"), ("x\n---\n", None, "x\n---\n"), ("---\na: 1\n---", "a: 1\n", ""), ("---\n---\nx", None, "x"), ("---\n\n---\nx", None, "x"),
        ("---\r\na: 1\r\n---\r\nx", "a: 1\r\n", "x"), ("---\na: 1\n--- \nx", None, "---\na: 1\n--- \nx"), ("---\na: 1\n", None, "---\na: 1\n"), (" ---\na: 1\n---\n", None, " ---\na: 1\n---\n"),
    ],
)
def test_frontmatter_split(text, matter, body):
    assert FM.split(text) == (matter, body)


def test_frontmatter_values():
    m = FM.load("a: yes\nb: 2024-01-01\nc: [1, 2.5, null, true]\nd: {z: 1, a: []}\ne: []\nf: 0x1F\n")
    assert m == {"a": "yes", "b": "2024-01-01", "c": [1, 2.5, None, True], "d": {"z": 1, "a": []}, "e": [], "f": 31}
    assert FM.tags(m) == [("a", '"yes"'), ("b", '"2024-01-01"'), ("c", "1"), ("c", "2.5"), ("c", "null"), ("c", "true"), ("d", '{"a":[],"z":1}'), ("f", "31")]
    assert FM.tags([1]) == [] and FM.tags("x") == []
    with pytest.raises(FM.FrontmatterError):
        FM.load("a: [1,\nb: }")
    assert parse_one("---\na: [1\n---\nx")["error"]


def test_titles():
    assert parse_one("# One\n")["title"] == "One"
    assert parse_one("---\ntitle: '  '\n---\n> # In a quote\n")["title"] == "In a quote"
    assert parse_one("---\ntitle: 5\n---\n## Two\n")["title"] is None
    assert parse_one("Set\n===\n")["title"] == "Set"


def test_empty():
    r = parse_one("")
    assert (r["title"], r["blocks"], r["links"], r["tags"], r["frontmatter"]) == (None, [], [], [], None)
    assert parse_one("---\ntitle: T\n---\n")["title"] == "T"


def test_task_items_have_no_block_of_their_own():
    r = parse_one("- [ ] open\n- [x] done\n- plain\n")
    assert kinds("- [ ] open\n- [x] done\n- plain\n") == ["list", "paragraph", "paragraph", "list_item", "paragraph"]
    assert [b["parent"] for b in r["blocks"]] == [None, 0, 0, 0, 3]


def test_nested_lists():
    text = "- a\n  - b\n    1. c\n    2. d\n- e\n"
    r = parse_one(text)
    assert kinds(text).count("list_item") == 5 and kinds(text).count("list") == 3
    assert [b["list_ordered"] for b in r["blocks"] if b["block_type"] == "list"] == [False, False, True]
    assert max(b["depth"] for b in r["blocks"]) == 6


def test_tables_and_cells():
    r = parse_one("| A | B |\n|---|:-:|\n| Yes | [p](q) |\n| x \\| y |\n\nafter")
    assert [b["block_type"] for b in r["blocks"]] == ["table", "paragraph"]
    assert r["blocks"][0]["text_content"] == "ABYespx | y"
    assert r["links"][0]["target"] == "q"
    assert kinds("a | b\nnot a delimiter") == ["paragraph"]


def test_footnotes():
    r = parse_one("Text[^n] here.\n\n[^n]: The *note*.\n\n[^unused]: gone\n")
    assert [(b["block_type"], b["text_content"]) for b in r["blocks"]] == [("paragraph", "Text here."), ("footnote_definition", "[^n]: The note."), ("paragraph", "The note.")]


@pytest.mark.parametrize(
    "text, plain",
    [
        ("a *b* **c** ***d*** ~~e~~ _f_", "a b c d e f"), ("snake_case_word", "snake_case_word"), ("`` a`b ``", "`a`b`"), ("a\nb  \nc\\\nd", "a b c d"), ("\\*not\\* &amp; &copy;", "*not* & ©"),
        ("2 * 3 * 4", "2 * 3 * 4"), ("<b>bold</b>", "bold"), ("**open", "**open"), ("[x](y 'title')", "x"), ("![alt *x*](y)", "alt x"), ("[not a link]", "[not a link]"), ("a ~b~ c", "a b c"), ("[a [b](c) d](e)", "[a b d](e)"),
    ],
)
def test_plain_text(text, plain):
    assert M.inline(text, M.Parser())[0] == plain


def test_links():
    assert links("<https://a.b/c> and <x@y.org>") == [("auto_link", "https://a.b/c", "https://a.b/c"), ("auto_link", "mailto:x@y.org", "x@y.org")]
    assert links("see https://a.b/c_d?e=1. And www.x.org") == [("auto_link", "https://a.b/c_d?e=1", "https://a.b/c_d?e=1"), ("markdown_link", "http://www.x.org", "www.x.org")]
    assert links("[a][r] [r] ![i][r]\n\n[r]: /url 'title'\n") == [("markdown_link", "/url", "a"), ("markdown_link", "/url", "r"), ("image_link", "/url", "i")]
    assert links("[![i](p)](q)") == [("markdown_link", "q", "i"), ("image_link", "p", "i")]
    assert links("[same](same)")[0][0] == "auto_link"
    assert links("`[no](link)`") == []


def test_wiki_links():
    assert M.wiki_links("[[a]] [[ b | c ]] [[]] [[x\ny]] [[|z]] `[[code]]` [[open") == [("a", "a"), ("b", "c"), ("code", "code")]
    assert parse_one("```\n[[in code]]\n```")["links"][0]["block"] is None


def test_html_and_code():
    assert kinds("<div>\nx\n</div>\n\npara") == ["html", "paragraph"]
    assert kinds("    indented\n\n    more\n\nx") == ["code_block", "paragraph"]
    assert parse_one("    a\n\n    b\n")["blocks"][0]["text_content"] == "a\n\nb\n"
    assert parse_one("~~~\n```\n~~~")["blocks"][0]["text_content"] == "```\n"
    assert parse_one("```rust,linenos\nx\n```")["blocks"][0]["language"] == "rust,linenos"
    assert parse_one("```\nx\n```")["blocks"][0]["language"] is None


def test_quotes():
    assert kinds("> a\nlazy\n> - b\n\nc") == ["block_quote", "paragraph", "list", "list_item", "paragraph", "paragraph"]
    assert parse_one("> a\nlazy")["blocks"][1]["text_content"] == "a lazy"


def test_never_fails():
    import random

    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", " ", "\n", "- ", "> ", "#", "```", "[", "]", "(", ")", "*", "_", "|", "---", "<", "!", "\\", "1. ", "[^a]", ":", "\t", "é", "&amp;", "~~", "[[", "]]"]) for _ in range(60))
        r = parse_one(text)
        assert all(b["parent"] is None or b["parent"] < b["ordinal"] for b in r["blocks"])


HARD = {
    "quotes": ">" * 3000 + " x", "lists": "- " * 2000 + "x", "list of rules": "* " * 30_000 + "x", "emphasis": "*a " * 20_000, "mixed": "a**b" + "c* " * 20_000, "ticks": " ".join("`" * i for i in range(1, 1500)), "brackets": "[a" * 20_000 + "]" * 20_000,
    "targets": "[a](b" * 20_000, "one word": "a" * 200_000, "addresses": "a@" * 30_000, "bare links": "http://a.b " * 20_000, "comments": "<!--" * 20_000, "declarations": "<!A " * 20_000, "tags": "<a " * 20_000, "spaces": "# " + " " * 50_000 + "x",
    "fence": "```" + " " * 50_000 + "x", "lazy lines": "> a\n" + "b\n" * 20_000, "definitions": "\n".join(f"[r{i}]: /u" for i in range(20_000)), "notes": "\n".join(f"[^{i}]: n [^{i + 1}]" for i in range(5000)) + "\n\n[^0]", "cells": "|".join("a" * 30_000),
}


@pytest.mark.parametrize("name", HARD)
def test_hard_texts_end_soon(name):
    began = time.perf_counter()
    row = parse_one(HARD[name])
    assert row["error"] is None and time.perf_counter() - began < 5


def test_deep_nesting():
    row = parse_one(">" * 3000 + " x")
    assert len(row["blocks"]) == 3001 and row["blocks"][-1]["depth"] == 3000 and all(b["text_content"] == "x" for b in row["blocks"])
    row = parse_one("- " * 2000 + "x")
    assert len(row["blocks"]) == 4001 and row["blocks"][-1]["parent"] == 3999
    row = parse_one("* " * 30_000 + "x")  # beyond the bound the marks are text
    assert row["blocks"][-1]["block_type"] == "paragraph" and row["blocks"][-1]["text_content"].endswith("* x")


def test_any_failure_is_a_row(monkeypatch):
    from mdlake.functions import markdown

    monkeypatch.setattr(markdown.Parser, "document", lambda *_: 1 // 0)
    row = parse_one("# x")
    assert row["error"].startswith("ZeroDivisionError") and row["blocks"] == []
