"""Tokenising, fingerprints, chat formats, mixing, pages and toxicity."""

import math
import random
import time
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm.bpe import Encoder, encoded, vocabulary_file
from barloom.llm.chat_format import chained, format_replies, parse_turns
from barloom.llm.hashing import WordHasher, buffers, chunks
from barloom.llm.html_text import Weights, counted, extract, learn_weights, main_texts
from barloom.llm.mixing import Mixture, fit_exponent, mixed, mixing_draws
from barloom.llm.token_counts import token_counts
from barloom.llm.toxicity import Training, fit, held_out, scored, train
from barloom.llm.winnowing import compare_edited, with_fingerprint

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = (
    "abcdefghij lmnoprstu '’ 0123 éèüßñİΣσς ÀÉ \x1c\x85​ 中文 ½²Ⅷ ́é 🙂 ǅ $%&*()_+ \t\n|<>"
)


def fuzz(seed, n, size=60):
    pick = random.Random(seed)
    texts = ["".join(pick.choice(ALPHABET) for _ in range(pick.randrange(size))) for _ in range(n)]
    return [*texts, "", " ", "it's <|endoftext|>We'LL<|startoftext|>", "a" * 700, "x " * 3000, "Å"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_words_and_hashes_of_any_slicing():
    texts = fuzz(1, 400)
    seen = {}
    for column in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts))):
        data, offsets = buffers(column)
        for i, j in chunks(offsets, 500):
            starts, ends, hashes, first = WordHasher().words(data, offsets[i : j + 1])
            for k in range(i, j):
                a, b = first[k - i], first[k - i + 1]
                found = [bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])]
                assert found == brute.words(texts[k])
                for word, h in zip(found, hashes[a:b].tolist()):
                    assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_proposals_and_merges_equal_the_library(library):
    encoder = Encoder(vocabulary_file(VOCABULARY))
    pick = random.Random(2)
    names = [n.replace("</w>", "") for n in encoder.vocabulary.ids]
    texts = fuzz(3, 1500) + ["".join(pick.choices(names, k=4)) for _ in range(3000)]
    words = [encoder.words(t) for t in texts]
    encoder.learn({w for ws in words for w in ws})
    for text, ws in zip(texts, words):
        want = library.encode(text, add_special_tokens=False)
        assert b"".join(encoder.ids_of[w] for w in ws) == pa.array(want.ids, pa.int32()).buffers()[1].to_pybytes()[: 4 * len(want.ids)]
        got = " ".join(encoder.text_of[w] for w in ws)
        assert got == library.decode(want.ids, skip_special_tokens=False)


def test_every_latin_letter_equals_the_library(spark, library):
    """Letters of U+00C0..U+024F, some of which have a lower case beyond that range."""
    latin = "".join(map(chr, range(0xC0, 0x250)))
    pick = random.Random(15)
    texts = [t for c in latin for t in (c, f"{c}na", f"a{c}b ba{c}")] + ["Ɗan Ɓauna", "Ɔkyeame"]
    texts += ["".join(pick.choices(latin + "abc '1", k=30)) for _ in range(500)]
    want = [library.encode(t, add_special_tokens=False) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in encoded(docs, VOCABULARY).collect()}
    said = [(w.ids, library.decode(w.ids, skip_special_tokens=False)) for w in want]
    assert [got[i] for i in range(len(texts))] == said
    counted = {r.doc_id: r.n_tokens for r in token_counts(docs, VOCABULARY).collect()}
    assert [counted[i] for i in range(len(texts))] == [len(w.ids) for w in want]


def test_encoded_documents_and_token_counts(spark, library):
    rows = [(i, t, None, "x") for i, t in enumerate(fuzz(5, 60))] + [(None, None, 1, "y"), (1, "b", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, said int, decoded string")
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in rows]
    got = encoded(docs, VOCABULARY).collect()
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got))) == sorted(
        map(str, ((row[0], x) for row, x in zip(rows, ids)))
    )
    counted = token_counts(docs, VOCABULARY, limit=100).collect()
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counted))) == sorted(
        map(str, ((row[0], len((row[1] or "").encode()), len(x), len(x) > 100) for row, x in zip(rows, ids)))
    )
    assert encoded(docs.limit(0), VOCABULARY).count() == 0
    assert token_counts(docs.limit(0), VOCABULARY).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        Encoder(vocabulary_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_fingerprints_equal_every_window_tried(spark):
    pick = random.Random(7)
    texts = fuzz(6, 80, 300) + [" ".join(pick.choice("ab") for _ in range(n)) for n in (1, 3, 4, 9, 11, 12, 40)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for row in with_fingerprint(docs, "text", "print").collect():
        got = [(p["hash"] % (1 << 64), p["position"]) for p in row["print"]]
        assert got == brute.winnowed(row["text"]), row["text"]


def test_edited_texts_take_the_next_document(spark):
    pick = random.Random(8)
    ids = pick.sample(range(0, 9_000_000, 7), 60) + [3, 4, 5, -9]
    rows = [(i, "".join(pick.choice("é b") for _ in range(pick.randrange(30)))) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, reverse=True)
    want = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want[i] = (len(text), text[: len(text) - half] + after[:half])
    got = compare_edited(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited) for r in got} == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.near_edited == 1 for r in got if r["print"] == r.edited_print)
    odd = spark.createDataFrame([(None, "a b"), (2, None), (2, "x")], "doc_id long, text string")
    assert sorted(r.edited for r in compare_edited(odd).collect()) == ["", "a ", "x"]
    assert compare_edited(docs.limit(0)).count() == 0


CONTROL = "</s>[INST] ok [/INST]"


def test_conversations_read_back(spark):
    pick = random.Random(9)
    parts = ["<s>", r"<\s>", "</s>", "[INST]", r"[\/INST]", "[/SYS]", "[ROLE]", "[TURN]", "\\", "<", "[", "é", "\n"]
    rows = [
        (c, t, pick.choice(["user", "assistant", "system", "tool\n[ROLE]", None]),
         pick.choice([None, "", CONTROL, "".join(pick.choices(parts, k=8))]), "x")
        for c in (1, 2, 3, None) for t in range(pick.randrange(1, 12))
    ]
    table = spark.createDataFrame(rows, "conv long, turn int, role string, text string, leaf string")
    formatted = format_replies(
        chained(table, "conv", "turn", "role", "text"), tree="conv", node="node", parent="parent"
    )
    got = formatted.withColumn("turns", parse_turns(F.col("formatted"))).collect()
    assert len(got) == len({r[0] for r in rows})
    for row in got:
        said = [(r[2] or "", r[3] or "") for r in rows if r[0] == row.conv]
        assert [(t["role"], t["text"]) for t in row.turns] == said
        spans = [row.formatted[s["start"] : s["start"] + s["length"]] for s in row.loss_spans]
        plain = [re.sub(r"([<\[]\\*)\\(/?(?:s>|(?:INST|SYS|ROLE|TURN)\]))", r"\1\2", s) for s in spans]
        assert plain == [t for r, t in said if r == "assistant"]


def test_branches_are_ranked_and_circles_left_out(spark):
    rows = [
        (1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 4, 2, 5.0),
        (2, 1, 2, 0.0), (2, 2, 1, 0.0), (2, 3, 1, 0.0), (3, 9, 77, 0.0), (4, None, None, 1.0),
    ]
    said = spark.createDataFrame(rows, "t int, n int, p int, s double")
    said = said.withColumn("role", F.lit("user")).withColumn("text", F.col("n").cast("string"))
    kinds = {"tree": "t", "node": "n", "parent": "p", "score": F.col("s")}
    got = format_replies(said, **kinds, branches=None).collect()
    assert sorted((r.t, r.leaf, r["rank"], r.score, r.n_turns) for r in got) == [
        (1, 3, 2, 2.0, 2), (1, 4, 1, 6.0, 3), (3, 9, 1, 0.0, 1),
    ]
    assert [r.leaf for r in format_replies(said, **kinds).where("t = 1").collect()] == [4]
    assert format_replies(said.limit(0), **kinds).count() == 0
    chain = spark.range(1, 301).select(
        F.lit(1).alias("t"), F.col("id").alias("n"), (F.col("id") - 1).alias("p"), F.lit(0.0).alias("s"),
        F.lit("user").alias("role"), F.col("id").cast("string").alias("text"),
    )
    (row,) = format_replies(chain, **kinds).collect()
    assert re.findall(r"\d+", row.formatted) == [str(i) for i in range(1, 301)]


def test_exponent_meets_entropy_and_repeats(spark):
    sizes = [1000, 100, 50, 10]
    sources = spark.createDataFrame([(str(n), n, n) for n in sizes], "source string, n_tokens long, n_docs long")

    def state(exponent):
        powers = [(n / sum(sizes)) ** exponent for n in sizes]
        weights = [p / sum(powers) for p in powers]
        return -sum(w * math.log(w) for w in weights), weights

    even, budget = fit_exponent(sources, Mixture(entropy=0.9, max_repeats=1e9, budget=1000))
    assert budget == 1000
    assert state(even)[0] == pytest.approx(0.9 * math.log(4), abs=1e-6)
    exponent, budget = fit_exponent(sources, Mixture(entropy=1.0, max_repeats=3.0))
    repeats = [w * budget / n for w, n in zip(state(exponent)[1], sizes)]
    assert max(repeats) == pytest.approx(3.0, abs=0.01) and min(repeats) == pytest.approx(1.0, abs=0.01)


def test_draws_keep_to_the_budgets(spark):
    pick = random.Random(12)
    rows = [(i, " ".join(["w"] * pick.randrange(9)), pick.choice(["a", "a", "a", "a", "b", None]), 0.5)
            for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    mixture = Mixture(entropy=1.0, max_repeats=2.5)
    draws = mixing_draws(docs, mixture).collect()
    tokens = {i: max(1, len(t.split())) for i, t, _, _ in rows}
    source = {i: s for i, _, s, _ in rows}
    held = {s: sum(n for i, n in tokens.items() if source[i] == s) for s in ("a", "b", None)}
    drawn = {s: sum(r.n_tokens for r in draws if r.source == s) for s in held}
    weight = {r.source: r.weight for r in draws}
    budget = max(held[s] / weight[s] for s in held)
    for s in held:
        assert abs(drawn[s] - weight[s] * budget) <= 9
    assert {r.doc_id for r in draws} == set(tokens)
    assert len({(r.doc_id, r.epoch) for r in draws}) == len(draws)
    again = mixing_draws(docs.repartition(7), mixture).collect()
    assert sorted(map(str, again)) == sorted(map(str, draws))
    taken = mixed(docs, mixture)
    assert taken.columns == docs.columns and taken.count() == len(draws)
    fewer = mixing_draws(docs, Mixture(budget=3000, entropy=0.5)).collect()
    assert abs(sum(r.n_tokens for r in fewer) - 3000) <= 27
    assert mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("repeats", [1.3, 1.5, 1.7])
def test_small_sources_keep_their_whole_epoch(spark, repeats):
    rows = [(i, "w", "a" if i < 101 else "b") for i in range(152)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draws = mixing_draws(docs, Mixture(entropy=1.0, max_repeats=repeats)).collect()
    assert sorted(r.doc_id for r in draws if r.source == "a") == list(range(101))
    assert {r.doc_id for r in draws if r.source == "b"} == set(range(101, 152))


FILL = " ".join(["word"] * 25)
PAGES = {
    f"<body class='has-sidebar'><nav>{FILL}</nav><div class=ad>{FILL}</div><article><h1>T</h1><p><b>a&amp;b"
    f"<br><p>{FILL}<script>if (a < b) x()</script></article><footer>f</footer>": f"T a&b {FILL}",
    f"<div id=content><p>{FILL}</p><div class='ad-slot'><p>buy</p></div><p>bo<i>l</i>d end of it</p></div>"
    f"<div class=comments><p>{FILL}</p></div>": f"{FILL} bold end of it",
    "": "", "<!-- c -->": "", "a < b": "a < b", "<p>open <script>x": "open", "<nav>m</nav>": "",
}


def test_pages(spark):
    rows = [(i, "u", page, "t") for i, page in enumerate(PAGES)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = learn_weights(table)
    got = {r.page_id: (r.text, r.n_chars) for r in main_texts(table, weights).collect()}
    want = {i: (text, len(text)) for i, text in enumerate(PAGES.values())} | {None: ("", 0)}
    assert got == want
    assert main_texts(table.limit(0), Weights()).count() == 0


def test_run_with_the_greatest_sum_is_found():
    weights = Weights(names={}, tags={"hr": -1.5})
    assert extract("a b<hr>c d e<hr>f", weights) == "a b c d e"
    assert extract("a<hr>c d e<hr>f", weights) == "c d e"


WHOLE = {
    "<html><head><meta><title>t</title><body><article>one two": "one two",
    "<head><link rel=x>\n<script>a</script><p>one": "one", "<head><title>t</title>one <b>two": "one two",
    "<head><style>a</style></head><p>one</head> two": "one two",
    "<p>one <svg/> two three</p><p>four": "one two three four",
    "<p>one <svg width='1' /> two <svg><text>no</text></svg> three": "one two three",
    "<p>one <svg> two": "one two", "<p>one <math> two <object data=x> three": "one two three",
    "<head-line>one</head-line> two": "one two", "<p>one<svg-icon></svg-icon> two": "one two",
    "<script src=x />a()</script>one": "one", "<script src=x /><p>one<script>a()</script> two": "one two",
    "<script src=http://x/>a()</script>one": "one", "<p>one<iframe src='x'/> two": "one two",
    "<title>no</title><p>one<style>x": "one", "<script src=a\">if (1) b()</script>one": "one",
}


@pytest.mark.parametrize("page", list(WHOLE))
def test_open_and_self_closing_elements_hide_no_text(page):
    assert extract(page, Weights()) == WHOLE[page]


@pytest.mark.parametrize("weights", [Weights(), Weights(tags={t: -1.5 for t in ("li", "tr", "td", "ul")})])
def test_lists_within_an_article_do_not_cut_it(weights):
    links = "<li><a href=x>go</a></li>" * 50
    cells = "<tr><td>v</td></tr>" * 50
    for inner, said in (
        (f"<ul>{links}</ul>", "go " * 50), (f"<nav><ul>{links}</ul></nav>", ""),
        (f"<table>{cells}</table>", "v " * 50), (f"<div class=related><div>{links}</div></div>", ""),
    ):
        page = f"<article><p>{FILL} start</p>{inner}<p>{FILL} end</p></article>"
        assert extract(page, weights) == f"{FILL} start {said}{FILL} end"


def test_toxic_words_are_learnt(spark):
    pick = random.Random(13)
    rows, marks = [], []
    for i in range(900):
        words = [f"w{pick.randrange(300)}" for _ in range(30)]
        if bad := i % 6 == 0:
            words[pick.randrange(30)] = "nasty" + pick.choice(["", "ly", "er"])
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(bad), 1))
    docs = spark.createDataFrame([*rows, (5000, None, "y"), (None, "", "z")], "doc_id long, text string, said string")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (7777, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = train(docs, labels, Training(l1=1.0))
    assert 3 < model.count() < 1000
    out = scored(docs, model).withColumn("out", held_out(F.col("doc_id"))).collect()
    assert len(out) == 902 and all(0 <= r.score <= 1 for r in out)
    for r in out:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    tested = [r for r in out if r.out and r.doc_id < 900]
    assert sum((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in tested) >= 0.97 * len(tested)
    unlabelled = train(docs, labels.limit(0))
    assert all(r.score < 1e-6 for r in scored(docs, unlabelled).collect())
    assert scored(docs.limit(0), model).count() == 0


def test_quotes_in_tags_follow_their_equals_sign():
    page = "<article><p>one two <a href=/x title=Bob's>link</a> three four don't five six</p>"
    assert extract(page, Weights()) == "one two link three four don't five six"
    assert extract("<p>one <a title=\"x>y</a> two three four", Weights()) == "one y two three four"
    assert extract("<p title='a > b' x=\"c > d\">one two", Weights()) == "one two"


@pytest.mark.parametrize("opening", [
    "<article class='widget-post'>", "<div class='share-price-story'>",
    "<div class='entry legal-analysis'>", "<section role=banner><article>",
])
def test_names_dont_speak_against_what_holds_the_page(opening):
    page = f"<nav>a b</nav>{opening}<p>{FILL}</p><div class=share>x y</div><p>more words follow here</p>"
    assert extract(page, Weights()) == f"{FILL} more words follow here"


def test_many_comments_are_not_the_article():
    page = f"<article><h1>Head</h1><p>{FILL}</p></article><div class=comments>{'<p>word ' * 500}</div>"
    assert extract(page, Weights()) == f"Head {FILL}"
    page = f"<h1>Head</h1><p>{FILL}</p><div class=comments>{'<p>word ' * 500}</div>"
    assert extract(page, Weights()) == f"Head {FILL}"


def test_deep_pages_take_linear_time():
    page = "<div class='a b'>" * 100_000 + f"<p>{FILL}" + "</div>" * 50_000 + "</span>" * 50_000
    started = time.monotonic()
    assert extract(page, Weights()) == FILL
    counted(f"<article>{page}</article>")
    assert time.monotonic() - started < 20


def test_repeated_pages_are_sampled_once(spark):
    page = "<article><p class=own>one two three</p></article><div class=outer>four</div>"
    rows = [(i, page) for i in range(8)]
    table = spark.createDataFrame(rows, "page_id long, html string")
    often = spark.createDataFrame(rows + [(3, page)] * 300, "page_id long, html string")
    assert learn_weights(table) == learn_weights(often)


def test_weights_count_words_and_tags_by_hand():
    page = "<div class=x>o<article class='x y'><nav>n n</nav><p>a b c</p></article></div><aside><p>q</aside>"
    got = counted(page)
    assert got["word", "p", True] == 3 and got["word", ".x", True] == 5 and got["word", ".x", False] == 1
    assert got["word", "nav", True] == 2 and got["word", "aside", False] == 1
    assert got["word", "p", False] == 0 and got["tag", "p", True] == 2 and got["tag", "nav", True] == 0


def test_fit_equals_coordinate_by_coordinate_ftrl():
    pick = random.Random(4)
    rows = [sorted(pick.sample(range(30), pick.randint(1, 9))) for _ in range(80)]
    marks = [float(3 in row or 7 in row) for row in rows]
    how = Training(epochs=3, l1=0.3, rarest=2)
    places, weights, bias = fit([np.array(r, dtype=np.int32) for r in rows], np.array(marks), how)
    seen = Counter(p for row in rows for p in row)
    z, n = Counter(), Counter()

    def weight(p):
        if abs(z[p]) <= how.l1:
            return 0.0
        rate = (how.beta + math.sqrt(n[p])) / how.alpha + how.l2
        return -math.copysign(abs(z[p]) - how.l1, z[p]) / rate

    order = np.random.default_rng(11)
    for _ in range(how.epochs):
        for i in order.permutation(len(rows)):
            used = [p for p in rows[i] if seen[p] >= how.rarest] + ["bias"]
            error = 1 / (1 + math.exp(-sum(weight(p) for p in used))) - marks[i]
            for p, w in [(p, weight(p)) for p in used]:
                step = (math.sqrt(n[p] + error**2) - math.sqrt(n[p])) / how.alpha
                z[p] += error - step * w
                n[p] += error**2
    want = {p: weight(p) for p in z if p != "bias" and weight(p) != 0}
    assert dict(zip(places.tolist(), weights)) == pytest.approx(want)
    assert bias == pytest.approx(weight("bias"))


def test_repeated_ids_stay_within_the_sample(spark):
    rows = [(i, f"word{i % 7} bad" if i % 3 else f"word{i % 5}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [rows[4]] * 2000, "doc_id long, text string")
    marks = [(i, int(i % 3 > 0)) for i in range(60)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    repeated = spark.createDataFrame(marks + [marks[4]] * 50, "doc_id long, toxic int")
    how = Training(l1=0.1)

    def model(*tables, how=how):
        return sorted(tuple(r) for r in train(*tables, how).collect())

    assert model(docs, labels) == model(often, repeated) and len(model(docs, labels)) > 1
    few = model(docs, labels, how=Training(l1=0.1, sample=10))
    assert few == model(often, repeated, how=Training(l1=0.1, sample=10)) != model(docs, labels)
    assert model(docs, labels, how=Training(l1=0.1, most=0)) == model(docs, labels.limit(0))
