"""Decontamination, toxicity, pages, archives and transcripts against direct versions."""

import math
import random
import time

import numpy as np
import pytest
from edge_cases import edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from codescope.llm import chat, decontam, html, toxicity, warc
from codescope.llm.queries import as_transcript
from codescope.llm.shared import written
from codescope.session import scratch_path

# --- decontamination ----------------------------------------------------------------


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    random.seed(3)
    word = lambda n: "".join(random.choice("abc") for _ in range(n))
    for _ in range(1500):
        pattern, text = word(random.randint(1, 12)), word(random.randint(0, 25))
        assert decontam.myers(pattern, text)[0] == least_edits(pattern, text)


def test_every_item_within_the_budget_is_found():
    random.seed(9)
    words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(k, prose(14)) for k in range(12)]
    matcher = decontam.Matcher(items, 0.08)
    for _ in range(150):
        k, item = random.choice(items)
        letters = list(item)
        for _ in range(random.randint(0, int(len(item) * 0.08) + 2)):
            letters[random.randrange(len(letters))] = random.choice(["", "x", "ab"])
        text = f"{prose(30)}\n {''.join(letters).upper()}  {prose(30)}"
        plain = decontam.normalized(text)[0]
        expected = {n for n, t in items if least_edits(t, plain) <= int(len(t) * 0.08)}
        found = matcher.find(text)
        assert {f[0] for f in found} == expected
        for n, start, end, edits in found:
            inside = decontam.normalized(text[start:end])[0]
            assert least_edits(dict(items)[n], inside) <= edits and 0 <= start < end <= len(text)


def test_copies_side_by_side_are_all_found():
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    matcher = decontam.Matcher([(1, item)], 0.08)
    for gap in (" ", "\n", " and ", " the lazy dog, and then "):
        copies = [item, item.replace("over", "ovr"), item.upper(), item.replace("river", "rivers")]
        text = gap.join(["Zz", *copies, "zz"])
        found = matcher.find(text)
        assert [f[3] for f in found] == [0, 1, 0, 1]
        assert [text[a:b] for _, a, b, _ in found] == copies
    assert len(matcher.find("\n".join([item] * 300))) == 300


def test_matches_of_tables(spark, edge_docs, no_docs):  # noqa: F811
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, "x" * 60), (3, "short"), (4, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    more = edge_docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in edge_docs.dtypes]).withColumns({"doc_id": F.lit(9), "text": F.lit("Zz  The QUICK brown\nfox jumps ovr the lazy dog near the river bank zz")})
    docs = edge_docs.unionByName(more)
    for shard_chars in (8_000_000, 60):
        found = decontam.find_matches(docs, bench, shard_chars=shard_chars)
        hits = sorted((r["doc_id"] or 0, r["item"], r["edits"]) for r in found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect())
        assert hits == [(0, 4, 0), (1, 4, 0), (1, 4, 0), (9, 1, 1)]
        clean = decontam.without_matches(docs, bench, shard_chars=shard_chars)
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 2, 3, 4, 5, 6]
    assert decontam.find_matches(no_docs, bench).count() == 0
    assert decontam.without_matches(edge_docs, bench.limit(0)).count() == 9


# --- toxicity -----------------------------------------------------------------------


def test_nearest_equals_all_cosines():
    random.seed(12)
    idf = np.array([1 + random.random() * 3 for _ in range(30)])
    some = lambda: sorted(random.sample(range(30), random.randint(1, 6)))
    examples = []
    for i in range(700):
        terms = some()
        examples.append((i, i % 2, *toxicity._weights(terms, [random.randint(1, 3) for _ in terms], idf)))
    index = toxicity.Index.build(examples, block=16)
    by_id = {e[0]: e for e in examples}
    for _ in range(100):
        terms = some()
        t, w = toxicity._weights(terms, [1] * len(terms), idf)
        query = dict(zip(t.tolist(), w.tolist()))
        cosine = {i: round(sum(query.get(int(a), 0) * b for a, b in zip(e[2], e[3])), 9) for i, e in by_id.items()}
        numbers, found = index.nearest(t, w, 10)
        best = sorted((c for c in cosine.values() if c > 0), reverse=True)[:10]
        assert np.allclose(found, best, atol=1e-8)
        assert all(math.isclose(cosine[index.ids[n]], c, abs_tol=1e-8) for n, c in zip(numbers, found))


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    x = rng.random(500)
    y = (rng.random(500) < x).astype(float)
    at, level = toxicity.isotonic(x, y, np.ones(500))
    assert (np.diff(at) > 0).all() and (np.diff(level) >= -0.2).all() and 0 < level.min() <= level.max() < 1


def toxic_table(spark, n=1200):
    random.seed(7)
    clean = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    insults = [f"insult{c}" for c in "abcdef"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [random.choice(clean) for _ in range(60)], int(i % 9 == 0)
        if toxic:
            for w in random.sample(insults, 2):
                words[random.randrange(60)] = w
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    scored = toxicity.assess(docs, labels.where("doc_id % 4 <> 2"))
    wrong = [r for r in scored.select("row.doc_id", "score", "evidence").collect() if (r["score"] >= 0.3) != (r["doc_id"] % 9 == 0)]
    assert len(wrong) <= 6
    assert all(0 <= r["score"] <= 1 for r in scored.select("score").collect())
    some = scored.where("row.doc_id = 18").first()
    assert some["evidence"] and some["evidence"][0]["label"] == 1


def test_toxicity_of_edge_rows(spark, edge_docs, no_docs):  # noqa: F811
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (77, 1)], "doc_id long, toxic int")
    for teach in (labels, labels.limit(0)):
        scored = toxicity.assess(edge_docs, teach)
        assert scored.select("row.*").columns == edge_docs.columns and scored.count() == 9
        assert all(0 < r["score"] < 1 for r in scored.collect())
    assert toxicity.assess(no_docs, labels).count() == 0


# --- pages --------------------------------------------------------------------------


def test_main_text():
    page = (
        "<!doctype html><html><head><title>t</title></head><body class='has-sidebar'><nav><a href=/>Home</a> <a href=/b>Away</a></nav>"
        "<!-- no <p>text</p> --><script>var t='</p>'</script><div id=top-banner>Buy!</div><article><header><h1>A &amp; B</h1></header>"
        "<p><b>First   block&nbsp;here.<br><p>Second <i>bl</i>ock.<ul><li>one<li>two</ul><form>mail <input></form>"
        "<div class='post-header'><p>By me</div><ol class='commentlist'><li>Nice!</ol></article><aside>more</aside><footer>&copy;</footer>"
    )
    assert html.main_text(page) == "A & B\n\nFirst block here.\n\nSecond block.\n\none\n\ntwo\n\nBy me"


def test_text_without_an_article_element():
    long = "Many words of an article that says this and that, at length, in sentences. " * 3
    page = f"<body><div class=menu><a>x</a></div><h1>T</h1><div><div><p>{long}<p>{long}</div><div><p>{long}</div></div><div>©</div></body>"
    assert html.main_text(page) == "\n\n".join(["T", *[long.strip()] * 3])


def test_odd_pages(spark):
    pages = [(1, None, "p", ""), (2, "", "p", ""), (3, "plain < text & more", "p", "plain < text & more"), (4, "<div>a</div>b", "p", "a\n\nb"), (5, "<p>open <b", "p", "open"), (6, "<br>" * 3, None, ""), (7, "<p>" + "a " * 50_000, "q", ("a " * 50_000).strip()), (7, "<p>x", "q", "x"), (7, "<p>x", "q", "x")]
    table = spark.createDataFrame(pages, "page_id long, html string, text string, expected string")
    found = html.extract(table)
    assert found.columns == table.columns and found.where("text <> expected").count() == 0 and found.count() == 9
    assert html.extract(table.limit(0)).count() == 0


def test_densities_lower_links():
    page = html.Page("<body><div>" + "word " * 50 + "</div><div><a>" + "word " * 50 + "</a></div></body>")
    own, total = html.densities(page, page.tag.index("body"))
    assert own[2] > own[3] and total[1] == own[2] + own[3]


# --- archives -----------------------------------------------------------------------


def test_archives_round_trip(spark):
    evil = "x" * 990 + warc.BOUNDARY + "WARC-Type: response\r\n\r\nhey" + warc.BOUNDARY + "\r\n\r\n"
    rows = [(1, "http://a.b/c d", evil, 1), (2, None, evil, 1), (3, "http://q/", "é\r\n\r\n", 1), (4, "u\r\nX: y", None, 1), (None, "z", evil, 1), (2, None, evil, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value int")
    path = scratch_path(spark, "warc-test")
    warc.write(warc.records(pages.repartition(2)), path)
    found = warc.read(spark, path)
    assert found.where("damaged").count() == 0 and found.count() == 18
    captures = warc.assemble(found).select("response.*", warc.field(F.col("metadata.block"), "page-id").alias("page"), warc.field(F.col("metadata.block"), "refers-to-page").alias("to"), "n_requests").collect()
    got = sorted((r["page"] or "", r["record_type"], bytes(r["payload"]).decode(), r["to"]) for r in captures)
    assert got == sorted([("1", "revisit", "", "2"), ("2", "response", evil, None), ("2", "response", evil, None), ("3", "response", "é\r\n\r\n", None), ("4", "response", "", None), ("", "response", evil, None)])
    path += "-none"
    warc.write(warc.records(pages.limit(0)), path)
    assert spark.read.text(path).count() == 0


def test_chains_of_identifiers(spark):
    """Links in either direction and over several records; records without a response."""
    rows = [
        ("r1", "response", ["q1"]), ("q1", "request", []), ("m1", "metadata", ["q1"]), ("m2", "metadata", ["m1"]),
        ("r2", "revisit", []), ("q2", "request", ["r2", "r2"]), ("q3", "request", []), ("m3", "metadata", ["q3"]), ("m4", "metadata", ["gone"]),
    ]
    table = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>")
    found = {r["record_id"]: r["capture"] for r in warc.captures_of(table).collect()}
    assert found == {"q1": "r1", "m1": "r1", "m2": "r1", "q2": "r2", "q3": "q3", "m3": "q3", "m4": "m4"}


# --- transcripts --------------------------------------------------------------------


def talk(spark, n=120):
    random.seed(4)
    rows = []
    for c in range(n):
        turns = (["system"] if c % 5 == 0 else []) + ["user", "assistant"] * random.randint(1, 3)
        for t, role in enumerate(turns):
            size = {"system": 30, "user": 12, "assistant": 60}[role]
            text = " ".join(random.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(random.randint(size // 2, size)))
            rows.append((c, t, role, (text + "?") if role == "user" else text + ".\n" + text + "."))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_come_back(spark):
    shown = written(as_transcript(talk(spark)), "shown")
    model = chat.fit(shown.where("conv_id % 4 <> 2"), "conv_id", "turn", F.col("line"), F.col("role"))
    found = {}
    for r in chat.parse(shown, model, "conv_id", "turn", F.col("line")).orderBy("key", "turn").collect():
        found.setdefault(int(r["key"]), []).append((r["role"], r["text"]))
        assert r["rendered"] == f"<|im_start|>{r['role']}\n{r['text']}<|im_end|>\n"
    true = {}
    for r in shown.orderBy("conv_id", "turn").collect():
        true.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert sum(found[c] == true[c] for c in true) >= 0.97 * len(true)


def viterbi(model, seen):
    """All lines at once."""
    score, back = model.start + sum(t[:, v] for t, v in zip(model.emit, seen[0])), []
    for s in seen[1:]:
        paths = score[:, None] + model.move
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + sum(t[:, v] for t, v in zip(model.emit, s))
    path = [int(score.argmax())]
    for came in back[::-1]:
        path.append(int(came[path[-1]]))
    return path[::-1]


def test_long_transcripts_decode_like_whole_ones():
    rng = np.random.default_rng(5)
    counts = {("move", s, t): int(rng.integers(1, 50)) for s in range(6) for t in range(6)}
    counts |= {(f, s, v): int(rng.integers(1, 50)) for f, n in chat.FEATURES.items() for s in range(6) for v in range(n)}
    model = chat.Model.of_counts(counts)
    seen = [tuple(int(rng.integers(0, n)) for n in chat.FEATURES.values()) for _ in range(5000)]
    decoder, path = chat.Decoder(model), []
    for s in seen:
        decoder.add(s)
        path += decoder.decided()
    assert len(path) > 3000
    assert path + decoder.rest() == viterbi(model, seen)


def test_markers():
    for line, expected in [("User: hi", ("user", "hi")), ("### Assistant", ("assistant", "")), ("**Human:** x", ("user", "x")), ("[system] y", ("system", "y")), ("<|im_start|>user", ("user", "")), ("A: b", ("assistant", "b")), ("User says hi", (None, "User says hi")), ("", (None, ""))]:
        assert chat.marker(line) == expected, line


def test_transcripts_of_odd_rows(spark):
    rows = [(1, 0, "User: a", 0), (1, 1, None, 0), (1, 2, "Assistant: b\n\n", 0), (1, 2, "Assistant: b\n\n", 0), (None, 0, "User: z", 0), (2, None, "", 0)]
    lines = spark.createDataFrame(rows, "conv_id long, turn long, text string, key int")
    labelled = as_transcript(talk(spark, 40))
    model = chat.fit(labelled, "conv_id", "turn", F.col("line"), F.col("role"))
    found = [(r["key"], r["role"], r["text"]) for r in chat.parse(lines, model, "conv_id", "turn", F.col("text")).orderBy("key", "turn").collect()]
    assert found == [(None, "user", "z"), ("1", "user", "a"), ("1", "assistant", "b"), ("1", "assistant", "b")]
    assert chat.parse(lines.limit(0), model, "conv_id", "turn", F.col("text")).count() == 0
    empty = chat.fit(labelled.limit(0), "conv_id", "turn", F.col("line"), F.col("role"))
    assert chat.parse(lines, empty, "conv_id", "turn", F.col("text")).count() > 0


SENTENCES = "".join(f"<p>Sentence number {i} of the article, with commas, is here.</p>" for i in range(16))


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize(
    "classes",
    ["layout has-sidebar", "no-sidebar", "header-fixed page", "search-page", "with-ads", "content widget-area", "post share-enabled", "login-required"],
)
def test_hint_words_on_a_wrapper_do_not_empty_the_page(tag, classes):
    page = f'<html><body><div class="{classes}"><{tag}>{SENTENCES}</{tag}><div class="sidebar">other things</div></div><div class="ad">buy</div></body></html>'
    text = html.main_text(page)
    assert text.count("Sentence") == 16 and "other" not in text and "buy" not in text


def test_teasers_and_comments_stay_out():
    page = f'<body><article>{SENTENCES}</article><div class="related"><article>A teaser.</article></div><div id="comments"><article>{SENTENCES * 3}</article></div></body>'
    assert html.main_text(page).count("Sentence") == 16 and "teaser" not in html.main_text(page)


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "deep", "<b>" * 100_000 + "deep" + "</i>" * 1000, "<p><b>" * 30_000 + "deep"])
def test_deep_pages_take_linear_time(source):
    start = time.time()
    assert html.main_text(source).endswith("deep")
    assert time.time() - start < 30


def test_densities_equal_their_definition():
    rng = random.Random(10)

    def tree(depth):
        kind = rng.choice(["text", "a", "div", "div", "span"]) if depth else "text"
        if kind == "text":
            return "word " * rng.randrange(6)
        return f"<{kind}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(4))) + f"</{kind}>"

    for _ in range(60):
        page = html.Page("<body>" + "".join(tree(4) for _ in range(5)) + "</body>")
        n, body = len(page.tag), page.tag.index("body")
        up = lambda i: [] if i < 0 else [i, *up(page.parent[i])]  # noqa: B023, E731
        below = [[j for j in range(n) if i in up(j)] for i in range(n)]
        linked = {i for i in range(n) if any(page.tag[j] == "a" for j in up(i))}
        size = lambda nodes: sum(len("".join(t.split())) for node, _, t in page.texts if node in nodes)  # noqa: B023, E731
        share = size(linked & set(below[body])) / max(1, size(set(below[body])))
        own = []
        for i in range(n):
            c, lc = size(set(below[i])), size(linked & set(below[i]))
            tags, link_tags = len(below[i]), sum(page.tag[j] == "a" for j in below[i])
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            ratio = max(1.0, c / max(1, lc) * tags / max(1, link_tags))
            own.append(max(0.0, c / tags * math.log(ratio) / (math.log(base) if base > 1 + 1e-9 else 1.0)) if c else 0.0)
        total = [sum(own[j] for j in range(1, n) if page.parent[j] == i) for i in range(n)]
        found = html.densities(page, body)
        assert found[0] == pytest.approx(own) and found[1] == pytest.approx(total)


def test_short_items_are_found_as_whole_words():
    matcher = decontam.Matcher([(1, "What is 2+2 in base 3? Show it."), (2, "cat"), (3, " \n"), (4, "C++")], decontam.ERROR_RATE)
    assert matcher.find("so: what is  2+2 in BASE 3?\nshow it. Then") == [(1, 4, 36, 0)]
    assert matcher.find("what is 2+2 in base 4? show it.") == []  # no edits in a short item
    assert matcher.find("concatenate cats") == [] and matcher.find("a cat, the CAT") == [(2, 2, 5, 0), (2, 11, 14, 0)]
    assert matcher.find("xcat cat.") == [(2, 5, 8, 0)] and matcher.find("use c++17, c++") == [(4, 4, 7, 0), (4, 11, 14, 0)]
