import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from hindcast.llm import chat, extraction
from hindcast.llm.queries import QUERIES

TEXT = st.text(alphabet="ab\\<[/]sINT \n>😀", max_size=20)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[x"]), TEXT), max_size=7))
def test_spans_locate_every_text_and_escapes_are_reversible(turns):
    run = chat.render_run(turns, [], chat.inst_template)
    assert not run["rewrites"]
    text = run["formatted"]
    assert run["turn_starts"] == [0, *run["turn_ends"][:-1]] [:len(turns)]
    for (_, want), a, b in zip(turns, run["text_starts"], run["text_ends"]):
        assert chat.unescape(text[a:b]) == want
    assert text.count("[INST] ") == sum(r == "user" for r, _ in turns)
    assert text.count("</s>") == sum(r == "assistant" for r, _ in turns)


def test_templates_that_rewrite_history_are_noticed():
    def last_only(turns):  # forgets what it had shown
        return "".join(f"({r}:{t if i == len(turns) - 1 else '...'})"
                       for i, (r, t) in enumerate(turns))

    def stripping(turns):
        return "".join(f"({r}:{t.strip()})" for r, t in turns)

    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    assert chat.render_run(turns, [], last_only)["rewrites"]
    assert chat.render_run([("user", " x ")], [], stripping)["rewrites"]
    assert not chat.render_run(turns, [], stripping)["rewrites"]


def brute(rows):
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by_id.items():
        turns.sort()
        all_text = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(all_text.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: tuple(r)[1:5] for r in df.collect()}


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST]"), (2, 1, "assistant", None),
    (2, 0, None, "x"), (2, None, "user", "first"), (3, 5, "user", "b"), (3, 5, "user", "a"),
    (3, 5, "user", "a"), (None, 0, "user", "no id"), (4, 0, "tool", "q" * 100_000),
    *[(5, k, ["user", "assistant"][k % 2], f"turn {k} \\[") for k in range(300)],
]


@pytest.mark.parametrize("run_turns", [1, 7, 64])
def test_digests_equal_brute_force(spark, run_turns):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df.withColumn("run", df["turn"]), run_turns=run_turns)
    out = chat.conversation_digests(formatted)
    assert digests(out) == brute(ROWS)
    rows = out.collect()
    assert {r["rewrites"] for r in rows} == {False}
    assert next(r["n_runs"] for r in rows if r["conv_id"] == 5) == -(-300 // run_turns)
    whole = chat.render_run([(r, t) for _, _, r, t in ROWS if _ is not None and r][:2], [],
                            chat.inst_template)
    assert next(r["formatted_chars"] for r in rows if r["conv_id"] == 1) == len(whole["formatted"])
    none = chat.format_conversations(df.filter("conv_id < 0"))
    assert chat.conversation_digests(none).count() == 0


def looking_back():
    # Made in a function, so that they are sent to the workers by value.
    def folds_system(turns):  # the first text goes into every user turn
        system = turns[0][1]
        return "".join(f"({r}:{system}|{t})" if r == "user" else f"({r}:{t})" for r, t in turns)

    def numbered(turns):
        return "".join(f"({n}:{r}:{t})" for n, (r, t) in enumerate(turns))

    def three_back(turns):
        return "".join(f"({turns[max(0, n - 3)][1]}>{t})" for n, (_, t) in enumerate(turns))

    def one_back(turns):
        return "".join(f"({turns[max(0, n - 1)][0]}>{t})" for n, (_, t) in enumerate(turns))

    def after_tool(turns):  # one turn changes all that follow
        out, seen = [], False
        for r, t in turns:
            seen = seen or r == "tool"
            out.append(f"({r}:{t}:{seen})")
        return "".join(out)

    return {"own": chat.inst_template, "one_back": one_back, "folds_system": folds_system,
            "three_back": three_back, "after_tool": after_tool, "numbered": numbered}


@pytest.mark.parametrize("name, whole, flagged", [
    ("own", True, False), ("one_back", True, False), ("folds_system", True, True),
    ("three_back", True, True), ("after_tool", False, True), ("numbered", False, True)])
def test_templates_that_look_over_a_border_are_right_or_noticed(spark, name, whole, flagged):
    template = looking_back()[name]
    turns = [("tool" if n == 3 else "user" if n % 2 else "assistant", f"text {n}")
             for n in range(71 + 64)]
    rows = [(1, n, r, t) for n, (r, t) in enumerate(turns)]
    rows += [(2, n, r, t) for n, (r, t) in enumerate(turns[:64])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df.selectExpr("*", "1 as own", "2 as place"), template).orderBy(
        "conv_id", "run").collect()
    assert [r["run"] for r in got] == [0, 1, 2, 0]
    joined = "".join(r["formatted"] for r in got[:3])
    assert (joined == template(turns)) == whole
    # All that came before the second run is known to it, whatever the template looks at.
    assert got[0]["formatted"] + got[1]["formatted"] == template(turns[:128])
    assert any(r["looks_back"] for r in got) == flagged and not got[3]["looks_back"]
    assert got[3]["formatted"] == template(turns[:64])
    digest = {r["conv_id"]: r["looks_back"] for r in chat.conversation_digests(
        chat.format_conversations(df, template)).collect()}
    assert digest == {1: flagged, 2: False}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    text = "</s>[INST] ok [/INST]"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(
        f"{folder}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    assert digests(QUERIES["op4_chat_formatting"](spark, folder)) == brute(rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies and more words about it than you would think</div>
<div class="ad">Buy this</div><aside>Side</aside>
<div class="wrap"><div class="post-{n}"><h1>Title {n}</h1><p>First &amp; <b>bo</b>ld&#33;
 line<br>after<p>Second {n} paragraph, rather long so that it counts.<script>var t="</p>";</script>
<!-- ad --><ul><li>Point</ul><form><p>Mail<input></form></div>
<div id="comments"><p>A reader says a lot of things here that are longer than the article itself,
 really much longer than the article itself, and goes on and on.</p></div></div>
<footer>&copy; all</footer>"""


def test_main_text_of_a_page():
    blocks = extraction.blocks_of(PAGE.format(n=3))
    path, _ = extraction.best_path(blocks)
    assert path == "html body div.wrap div.post-0"
    assert extraction.text_under(blocks, path) == (
        "Title 3 First & bold! line after Second 3 paragraph, rather long so that it counts. Point")


@given(st.text(alphabet="<>/pdiv =\"'!-&;#a\n", max_size=60))
def test_any_markup_is_read(text):
    blocks = extraction.blocks_of(text)
    assert all(b.text == " ".join(b.text.split()) and b.text for b in blocks)
    extraction.text_under(blocks, extraction.best_path(blocks)[0])


def test_hosts_agree_on_a_path(spark):
    pages = [(n, f"http://WWW.a.org:80/{n}", PAGE.format(n=n)) for n in range(6)]
    # A page whose teaser list outweighs its article follows its host.
    teaser = "<div class=teasers>" + "<p>Another story that is told at length elsewhere.</p>" * 9
    odd = PAGE.format(n=7).replace('<div class="wrap">', teaser + '</div><div class="wrap">')
    rows = pages + [(6, "http://www.a.org/x", odd), (7, None, None), (8, "", ""),
                    (9, "https://b.org/", "<article><p>One<p>Two</article><p>Not"),
                    (10, "http://www.a.org/y", "<p>Plain page"), (10, "http://www.a.org/y",
                                                                  "<p>Plain page")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "url as host", "1 as path")
    got = {r["page_id"]: r for r in extraction.extract(df).collect()}
    assert len(got) == 11 and extraction.extract(df).count() == 12
    assert got[6]["text"].startswith("Title 7 First") and "Another" not in got[6]["text"]
    assert (got[7]["text"], got[8]["text"], got[7]["n_chars"]) == ("", "", 0)
    assert got[9]["text"] == "One Two" and got[10]["text"] == "Plain page"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extraction.extract(df.filter("page_id < 0")).count() == 0


def test_query_reads_the_article_of_every_page(spark):
    import re
    from html import unescape

    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(
        f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op10_extraction"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", inner)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == " ".join(p for p in parts if p)
