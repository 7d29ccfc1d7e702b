"""Operators on single texts: against brute force, SQL or round trips, and on hard cases."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquarry.llm import decontaminate as decontamination
from reelquarry.llm import language_id, queries, toxicity
from reelquarry.llm.chat_format import CONTROLS, escape, format_conversations, read_back, turns_of, unescape
from reelquarry.llm.decontaminate import decontaminate
from reelquarry.llm.html_extract import Line, extract_text, main_lines, main_text
from reelquarry.llm.license_scan import TEMPLATES, Index, scan_licenses, words_of
from reelquarry.llm.piece_lattice import MODEL_PATH, Vocabulary, changed, decode, encode, encode_documents, encode_texts
from reelquarry.llm.quality_rules import quality_rules
from reelquarry.llm.url_filter import filter_urls
from tests.compare import assert_same
from tests.conftest import SF

HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (None, "null id"), (5, "long " * 60_000), (6, "same"), (6, "same"), (7, "\x00\x01\x02 ☃ é 日本")]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, repeated rows, and other columns with the names of results."""
    return spark.createDataFrame([(i, t, None, None, 1, "x") for i, t in HARD], "doc_id long, text string, lang string, source string, id int, score string")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    assert_same(queries.queries()[name](spark, str(SF)), queries.oracle_sql()[name], oracle)


def test_html():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    page = """<html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
    <div class="cookie-notice">We use cookies, many of them, and long words about them.</div><script>var t="</p>";</script>
    <article><header><h1>A &amp; B</h1><span>by me</span></header><p>First   line
    goes on<p>Second <b>bold</b> one.<aside>See also</aside><p>End.<div class="comments"><p>I agree with every word of this long text</div></article>
    <div id="sidebar"><p>Popular things to read now and later</p></div><form>Search <input></form><footer>&copy; me</footer></body>"""
    assert main_text(page) == "A & B\n\nFirst line goes on\n\nSecond bold one.\n\nEnd."
    body = "A sentence that is long enough to count as text of the page. " * 3
    plain = f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div><p>{body}<p>Short.<p>{body}</div><div><a href=c>Next page of news</a></div>"
    assert main_text(plain) == "\n\n".join([body.strip(), "Short.", body.strip()])
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<article><p>one<p title='a>b'>two<br>three</arti") == "one\n\ntwo three"
    assert len(main_text("<article><p>" + "x <b " * 20_000)) > 0 and main_text("<" * 50_000) == "<" * 50_000


def slow_main_lines(lines, window=3, surge=80, share=0.15):
    """Runs between places where `window` lines from there on weigh nothing, each weighed by its heaviest window."""
    cells = []
    for x in lines:
        cells += [None] * window if x is None else [x]
    weigh = lambda k: sum(c.weight for c in cells[k : k + window] if c)
    sums = [weigh(k) for k in range(len(cells))]
    runs, now = [], []
    for k in range(len(cells)):
        if sums[k]:
            now.append(k)
        if now and (not sums[k] or k == len(cells) - 1):
            runs.append(now)
            now = []
    peak = max(sums, default=0)
    keep, sections = set(), set()
    for run in runs:
        if max(sums[k] for k in run) >= max(min(surge, peak), share * peak):
            heavy = [k for k in range(run[0], run[-1] + window) if k < len(cells) and cells[k] and cells[k].weight]
            keep.update(range(heavy[0], heavy[-1] + 1))
            sections.update(cells[k].section for k in heavy)
    same = lambda c: c.section and c.section in sections and (c.article or c.weight)
    return [c.text for k, c in enumerate(cells) if c and c.text and (k in keep or same(c))]


def test_surges_and_dives_equal_plain_form():
    random.seed(15)
    for _ in range(3000):
        lines = []
        for k in range(random.randint(0, 25)):
            weight = random.choice([0, 0, 0, 5, 30, 90, 700])
            lines.append(None if random.random() < 0.1 else Line(f"line {k}" if weight or random.random() < 0.5 else "", weight, random.randint(0, 3), random.random() < 0.3))
        assert main_lines(lines) == slow_main_lines(lines), lines


def test_lengths_and_not_names_decide():
    sentence = "A sentence of the page that is long enough to count as text."
    body = "".join(f"<p>{sentence}" for _ in range(10))
    whole = "\n\n".join([sentence] * 10)
    assert main_text(f"<article class='teaser'>Hi</article><div>{body}</div>") == whole
    assert main_text(f"<div>An unmarked advert of a shop, some forty letters</div><article>{body}</article><div>&copy; someone, all rights reserved</div>") == whole
    assert main_text(f"<main>{body}</main><article>Another page's teaser</article>") == whole
    # where a section surged, what is short in it is text too
    assert main_text(f"<main>{body}<div class=ad>1</div><div class=ad>2</div><nav>3</nav><ul><li><a href=x>A source</a></ul><p>End.</main><p>x") == f"{whole}\n\nA source\n\nEnd."
    assert main_text(f"<div>{body}<div class='ad'>buy</div><p>Short.</div><div class='comments'>{body}</div>") == f"{whole}\n\nShort."
    named = "<div class='search-results'>found</div><p class='print'>printed</p><section class='social-science'>sociology</section>"
    assert main_text(f"<article>{named}<div class='cookie-notice'>c</div><div class='adBanner x'>d</div></article>") == "found\n\nprinted\n\nsociology"
    # names are weights: with one surge above all others there is nothing else
    assert main_lines([Line("a", 50), None, Line("b", 60)]) == ["b"] and main_lines([]) == main_lines([None, Line("x", 0)]) == []


def test_furniture_that_is_not_closed():
    text = "A sentence of the page that is long enough to count as text."
    for page in (
        f"<body><nav><ul><li><a href=/>Home</a></ul><article><p>{text}</article></body>",
        f"<body><nav><ul><li><a href=/>Home</a></ul><div><p>{text}</div></body>",
        f"<body><div class='ad'>Buy now<article><p>{text}</article></body>",
        f"<form><main><p>{text}</main></form>",
        f"<div><nav><a href=/>Home</a></div><p>{text}",
        f"<article><p>{text}</article><footer>a footer that nobody closed, though it is long enough to be taken for the text of a page",
        f"<aside>see this<h1>{text}</h1>",
    ):
        assert main_text(page) == text, page


def test_html_takes_linear_time():
    import time

    def seconds(page):
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    for make in (lambda n: "<script>" + "</script" * n, lambda n: "<nav>" + "<div class=ad>" * n, lambda n: "<a b='" * n, lambda n: "<aside>" * n + "<p>x" * n, lambda n: "<article>" * n + "<p>x" * n):
        assert seconds(make(40_000)) < 5


def test_html_frame(spark):
    rows = [(1, "u", None), (1, "u", "<p>hi</p>"), (None, None, "<article>é</article>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted(map(str, (tuple(r) for r in extract_text(df).collect())))
    assert got == sorted(["(1, 'u', '', 0)", "(1, 'u', 'hi', 2)", "(None, None, 'é', 1)"])
    assert extract_text(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_escape_is_reversible():
    random.seed(2)
    atoms = [*CONTROLS, "<", "\\", "/s>", "s>", "[", "a", "\n", "|>"]
    for _ in range(3000):
        text = "".join(random.choices(atoms, k=random.randint(0, 8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROLS)


def test_chat(spark):
    random.seed(4)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (3, None, None, None), (3, 1, "]\n</s>", "x"), (None, 1, "user", "a")]
    for conv in range(10, 25):
        role = ["system"] * (conv % 2) + ["user", "assistant"] * 20
        rows += [(conv, k, role[k], " ".join(random.choices(["<s>", "word", "\\", "é\n"], k=random.randint(0, 90)))) for k in range(random.randint(1, 40))]
    df = spark.createDataFrame([(*r, 1) for r in random.sample(rows, len(rows))], "conv_id long, turn long, role string, text string, window int")
    windows = format_conversations(df, budget=120, history=40)
    got = {r["conv_id"]: r for r in read_back(windows).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sorted(map(str, read_back(windows, together=True).collect())) == sorted(map(str, got.values()))
    for w in windows.collect():
        turns = turns_of(w["formatted"])
        assert len(turns) == w["n_repeated"] + w["n_new"]
        assert w["n_tokens"] <= 120 or w["over_budget"]
        if w["conv_id"] and w["conv_id"] >= 10 and w["conv_id"] % 2:
            assert turns[0][0] == "system"
    assert read_back(format_conversations(df.limit(0))).collect() == []


def test_language(spark, hard):
    words = {"xx": ["kala", "moto", "nika"], "yy": ["grz", "brzt", "szcz"]}
    random.seed(5)
    docs = [(k, " ".join(random.choices(words[x], k=30)), x) for k, x in enumerate(random.choices(["xx", "yy"], k=120))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.identify_language(df, model).collect()}
    assert all(got[i]["lang_pred"] == x and 0 <= got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, x in docs)
    for r in language_id.identify_language(hard, model).collect():
        text = dict((i, t) for i, t in HARD)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text))
    far = spark.createDataFrame([(1, "日本語 の 文章 です")], "doc_id long, text string")
    assert language_id.identify_language(far, model).first()["rejected"]
    assert language_id.fit(df.limit(0)) is None and language_id.identify_language(hard, None).filter("lang_pred = 'und'").count() == len(HARD)


def slow_judgement(model, text):
    """Language and cosine of a text, from its n-grams' counts, one centroid at a time."""
    grams = language_id.gram_counts(text)
    vector = [float(np.log1p(c)) * float(w) for c, w in zip(grams, model.idf, strict=True)]
    norm = sum(v * v for v in vector) ** 0.5
    found = [(sum(v / norm * float(c) for v, c in zip(vector, centre, strict=True)), model.languages[k]) for centre, k in zip(model.centroids, model.owner, strict=True)]
    return max(found, key=lambda f: f[0])


def test_language_equals_plain_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1) and len(model.owner) <= 3 * len(model.languages)
    some = docs.filter("length(text) > 50").orderBy("doc_id").limit(25)
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in language_id.identify_language(some, model).collect():
        cosine, lang = slow_judgement(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["cosine"] - cosine) < 1e-4
    own = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 5)
    copies = spark.createDataFrame([(own, "kala moto nika", "xx")] * 3000 + [(k, "grz brzt szcz", "yy") for k in range(50)], "doc_id long, text string, lang string")
    assert language_id.fit(copies, sample_rows=20).languages == ["xx", "yy"]
    assert language_id.identify_language(docs.limit(0), model).collect() == []


def test_language_counts_do_not_depend_on_chunks(monkeypatch):
    text = "Wörter, und  Zeichen! 12 ñandú" * 20
    whole = language_id.gram_counts(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(language_id, "_CHUNK", size)
        assert (language_id.gram_counts(text) == whole).all()


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()


def slow_verdict(url, rules):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate({k: k + 32 for k in range(65, 91)}), found[2]) if found else ("", "")
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_urls(spark, ranges):
    random.seed(6)
    hosts = ["".join(h) for h in product(["", "a.", "b.a.", "net.", "-a."], ["net", "example.net", "xnet", "org", "NET", "net:80"])]
    urls = [f"{s}{h}{p}" for s in ("http://", "x", "a://b://") for h in hosts for p in ("", "/", "/en/", "/en", "?/en/", "/fr/x#y", "//en/")]
    urls += ["http://net\x01evil/a", "http://a.net\x01evil/a", "http://\x02.net/", "http://x\x01.net/en/", None, "", "://", "http:///x", "http://\n/é"] + ["http://hot.net/en/1"] * 200
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("net", "/en/", "allow"), ("b.a.net", "", "allow"), ("org", "/fr/", "allow"), ("net", "/", "block"), ("net\x01evil", "/a", "block")]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    known = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, known, ranges=ranges).collect()}
    assert got == {k: slow_verdict(u, rules) for k, u in enumerate(urls)}
    assert filter_urls(df.limit(0), known).collect() == []


def slow_contamination(text, items):
    words = words_of(text.encode()) if text else []
    hit, found = set(), set()
    for item, own in items:
        own = words_of(own.encode()) if own else []
        size = min(13, len(own))
        windows = {tuple(own[s : s + size]) for s in range(len(own) - size + 1)} if size else ()
        for p in range(len(words) - size + 1) if windows else ():
            if tuple(words[p : p + size]) in windows:
                hit.update(range(p, p + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("bits", [24, 6])
def test_contamination(spark, hard, bits, monkeypatch):
    monkeypatch.setattr("reelquarry.llm.decontaminate.MOST_BITS", bits)  # a full bitmap lets through what the join then drops
    random.seed(8)
    make = lambda n: " ".join(random.choices(["a", "B", "c1", "é", "dd"], k=n))
    items = [(1, make(30)), (2, make(13)), (3, "only four words here"), (4, "a"), (None, "null item " * 9), (12, "long " * 300), (5, None), (6, ""), (7, make(200)), (1, make(14)), (10, "x-y z")]
    docs = []
    for k in range(60):
        part = random.choice([t for _, t in items if t])
        docs.append((k, f"{make(random.randint(0, 60))}! {part if k % 3 else part[5:]}; {make(5)}"))
    docs += HARD + [(3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int")
    got = sorted((str(r["doc_id"]), *[r[k] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]) for r in decontaminate(df, bench).collect())
    assert got == sorted((str(i), *slow_contamination(t, items)) for i, t in docs)
    assert decontaminate(df, bench.limit(0)).filter("contaminated OR n_hit > 0").count() == 0
    assert decontaminate(df.limit(0), bench).collect() == []


def test_a_large_benchmark_costs_no_more_passes(spark, monkeypatch):
    """A benchmark of some hundred thousand windows is looked up in as many passes over the documents as a small one."""
    random.seed(18)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    items = [(k, " ".join(word() for _ in range(400))) for k in range(300)]
    docs = [(k, " ".join([word() for _ in range(30)] + items[k][1].split()[k : k + 14 - k % 3] + [word()])) for k in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    passes = []
    for name in ("_frequencies", "_candidates"):
        own = getattr(decontamination, name)
        monkeypatch.setattr(decontamination, name, lambda *a, own=own, name=name: passes.append(name) or own(*a))
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate(df, bench).collect()}
    assert got == {k: (14 - k % 3, [str(k)]) if k % 3 < 2 else (0, []) for k in range(60)}
    assert passes == ["_frequencies", "_candidates"]


@pytest.fixture(scope="module")
def pieces():
    return Vocabulary.load()


@pytest.fixture(scope="module")
def plain_pieces():
    """Pieces with ids and Zipf's log-probabilities of their ranks, straight from the model; and what a character without a piece costs."""
    import math

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    ranks = {i: -model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    last = max(r for r in ranks.values() if r < 1e8)
    ranks = {i: r if r < 1e8 else last + 1 for i, r in ranks.items()}
    total = sum(1 / (r + 1) for r in ranks.values())
    scores = {i: -math.log(r + 1) - math.log(total) for i, r in ranks.items()}
    first_byte = next(i for i in range(model.get_piece_size()) if model.is_byte(i))
    return {model.id_to_piece(i): (i, s) for i, s in scores.items()}, -math.log(last + 1) - math.log(total) - 10, first_byte


def slow_paths(text, plain):
    known, unknown, first_byte = plain

    def go(at):
        if at == 0:
            return [(0.0, ())]
        own = [(begin, *known[text[begin:at]][::-1]) for begin in range(at) if text[begin:at] in known]
        found = [(s + score, (*before, i)) for begin, score, i in own for s, before in go(begin)]
        if text[at - 1] not in known:
            found += [(s + unknown, (*before, *(first_byte + b for b in text[at - 1].encode()))) for s, before in go(at - 1)]
        return found

    return sorted(go(len(text)), key=lambda p: -p[0])


def test_pieces_n_best(pieces, plain_pieces):
    random.seed(9)
    texts = ["".join(random.choices("aeinst hé▁日\n☃", k=random.randint(1, 7))) for _ in range(150)]
    for count in (1, 3, 6):
        for text, e in zip(texts, encode_texts(texts, pieces, count), strict=True):
            ids = e.ids.tolist()
            got = [(e.score, tuple(ids))] + [(s, tuple(changed(ids, c))) for s, c in e.others]
            everything = slow_paths("▁" + text.replace(" ", "▁"), plain_pieces)
            want, score_of = everything[:count], {ids: s for s, ids in everything}
            assert len(set(got)) == len(want) and all(abs(a[0] - b[0]) < 1e-6 for a, b in zip(got, want, strict=True))
            assert all(abs(score_of[ids] - s) < 1e-6 for s, ids in got)


def test_pieces_do_not_depend_on_batches(pieces, monkeypatch):
    random.seed(19)
    texts = ["".join(random.choices("aeinst  hé▁日\n☃.", k=random.randint(0, 60))) for _ in range(40)] + ["", "the " * 300, "x" * 3000]
    whole = list(encode_texts(texts, pieces))
    monkeypatch.setattr("reelquarry.llm.piece_lattice.SLICE_CHARS", 7)
    monkeypatch.setattr("reelquarry.llm.piece_lattice.SLICE_CELLS", 50)
    for text, e in zip(texts, whole, strict=True):
        other = encode(text, pieces)
        assert other.ids.tolist() == e.ids.tolist() and abs(other.score - e.score) < 1e-6 and len(other.others) == len(e.others)


def test_scores_of_a_unigram_model_stay():
    words = Vocabulary({"a": (1, -1.5), "ab": (2, -1.0), "b": (3, -2.25)}, [b"", b"a", b"ab", b"b"], None, 0)
    e = encode("ab", words, 3)
    assert e.ids.tolist() == [0, 2] and abs(e.score - (-1.0 - 2.25 - 10)) < 1e-9


def test_pieces_round_trip(spark, pieces, hard):
    for text in ("", " ", "  a  b ", "\n\t☃ é 日本", "x" * 5000, "a\x00b"):
        assert decode(encode(text, pieces).ids, pieces) == text
    got = encode_documents(hard, words=pieces, keep=("lang",)).collect()
    assert len(got) == len(HARD) and all(r["round_trip"] for r in got) and sum(r["n_pieces"] == 0 for r in got) == 2
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert encode_documents(docs, words=pieces).filter("NOT round_trip").count() == 0
    assert encode_documents(docs.limit(0), words=pieces).collect() == []


def slow_features(word):
    """Weights of the gapped subsequences of three characters, start and end included, that span six at most."""
    marked, found = ["start", *word, "end"], {}
    for i in range(len(marked)):
        for j in range(i + 1, len(marked)):
            for k in range(j + 1, min(len(marked), i + 6)):
                key = (marked[i], marked[j], marked[k])
                found[key] = found.get(key, 0.0) + 0.55 ** (k - i - 2)
    return found


def slow_cosine(a, b):
    a, b = slow_features(a), slow_features(b)
    dot = sum(v * b.get(k, 0.0) for k, v in a.items())
    return dot / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5


def test_kernel_equals_brute_force_and_is_one():
    random.seed(16)
    words = sorted({"".join(random.choices("abcé☃", k=random.randint(1, 12))) for _ in range(60)} | {"aaaaaaa", "abababab", "moron", "moroon", "mo.ron"})
    marks = toxicity.Landmarks(words)
    kernel = marks.kernel(words)
    assert np.allclose(kernel, [[np.exp((slow_cosine(a, b) - 1) / 0.2) for b in words] for a in words])
    assert np.allclose(kernel, kernel.T) and np.linalg.eigvalsh(kernel).min() > -1e-9 and np.allclose(np.diag(kernel), 1)
    for size in (2, 14, 40):
        for _ in range(10):
            some = random.sample(words, size)
            assert np.linalg.eigvalsh(toxicity.Landmarks(some).kernel(some)).min() > -1e-9
    few = toxicity.Landmarks(words[:7])
    near, values = few.features(words)
    cosines = np.array([[slow_cosine(a, b) for b in words[:7]] for a in words])
    assert near.tolist() == np.nonzero(cosines.max(axis=1) >= 0.3)[0].tolist() and np.allclose(values, np.exp((cosines[near] - 1) / 0.2))
    assert slow_cosine("moron", "moroon") > slow_cosine("moron", "mo.r.on") > 0.4


def test_very_long_tokens_are_judged_whole():
    for token in ("x" * 95 + "moron", "x" * 200 + "m.o.r.o.n" + "y" * 70, "a-" * 60):
        pieces = toxicity._pieces(token)
        assert max(map(len, pieces)) <= toxicity.LONGEST
        for form in {token, re.sub(r"[\W_]", "", token)}:
            assert all(any(form[k : k + 20] in p for p in pieces) for k in range(len(form) - 19))


def test_toxicity_held_out(spark):
    """Of the largest table's texts that the model has not seen (97 toxic, 728 clean), 90 and 13 were taken for toxic; with five times the labels 427 of 427, and none of 3,634."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels.filter(toxicity.fold(F.col("doc_id")) == 0), "doc_id").select("doc_id", "text", "toxic")
    got = toxicity.score_toxicity(held, model).join(held.select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in got}
    assert share[1] >= 0.85 and share[0] <= 0.03


def test_toxicity(spark, hard):
    random.seed(10)
    clean = ["table", "river", "moreon", "cloud", "idea", "green", "walk", "stone", "paper"] + [f"w{k}ord" for k in range(60)]
    docs = [(k, " ".join(random.choices(clean, k=40)) + (f" {random.choice(['moron', 'idiot'])} ." if k % 5 == 0 else " ."), int(k % 5 == 0)) for k in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(9999, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(df, model).collect()}
    assert all(got[i] == y for i, _, y in docs)
    tried = ["you moron", "an idi*ot", "i d i o t", "i.d.i.o.t", "stone river", "", "moroon"]
    scores = model.scores(model.margins(tried))
    assert (scores[[0, 2, 3, 6]] > 0.5).all() and (scores[[4, 5]] < 0.5).all() and scores[1] > scores[4]
    rows = toxicity.score_toxicity(hard, model).collect()
    assert len(rows) == len(HARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert isinstance(toxicity.fit(df, labels.limit(0)), float)
    assert toxicity.score_toxicity(hard, 0.1).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(hard.limit(0), model).collect() == [] and toxicity.fit(df.limit(0), labels) == 0.0


def test_marking_tokens_are_of_distinct_texts_and_all_kept(spark, monkeypatch):
    class Seen(Exception):
        pass

    def see(toxic, clean, background):
        raise Seen(toxic)

    monkeypatch.setattr(toxicity, "train", see)

    def marks(toxic):
        random.seed(14)
        rows = [(k, " ".join(random.choices([f"w{n}ord" for n in range(60)], k=20)), 0) for k in range(800)]
        rows += [(1000 + k, t, 1) for k, t in enumerate(toxic)]
        df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
        with pytest.raises(Seen) as seen:
            toxicity.fit(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
        return seen.value.args[0]

    insults = [f"you {('moron', 'idiot')[k % 2]} w{k}ord" for k in range(120)]
    assert {"moron", "idiot"} <= set(marks(insults + [" ".join(f"rare{n}" for n in range(450))] * 200)) <= {"you", "moron", "idiot"}
    many = {f"mark{n}" for n in range(450)}
    assert many <= set(marks([f"{' '.join(sorted(many))} own{k}" for k in range(60)]))


def test_quality_counts_words_of_repeated_windows(spark):
    """Against brute force, on texts whose words repeat much more often than their windows."""
    rng, texts = random.Random(5), []
    for size in range(60):
        texts.append(" ".join(rng.choice("abcdef"[: 2 + size % 5]) for _ in range(3 * size)))
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    for k, text in enumerate(texts):
        words = text.split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        assert (got[k]["n_words"], got[k]["n_repeat_words"], got[k]["word_chars"]) == (len(words), len(hit), len("".join(words)))


def test_quality_on_hard_rows(spark, hard):
    got = quality_rules(hard, keep=("lang",)).collect()
    assert len(got) == len(HARD)
    assert all(r["base_failed"] and not r["kept"] for r in got)
    long = next(r for r in got if r["doc_id"] == 5)
    assert (long["n_words"], long["n_repeat_words"], long["word_chars"]) == (60_000, 60_000, 240_000)
    assert quality_rules(hard.limit(0)).collect() == []


def test_frequent_lines_go(spark):
    random.seed(11)
    own = lambda: " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(30))
    docs = [(k, f"Menu and Contact of this site\n{own()}", "h1") for k in range(40)] + [(100 + k, own(), "h2") for k in range(40)]
    docs += [(200 + k, docs[50][1], "h2") for k in range(60)] + [(300, " \n".join(["Menu and contact OF this site "] * 3), "h1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert all(r["kept"] for i, r in got.items() if i != 300)
    assert got[0]["n_removed_words"] == 6 and "\n" not in got[0]["clean_text"] and got[100]["n_removed_words"] == 0
    assert not got[300]["kept"] and got[300]["depleted"]


def test_filter_on_verdict_stays_above_measures(spark, hard):
    plan = quality_rules(hard).filter("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") < 40


def test_licenses(spark, hard):
    index = Index(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for text in texts:
            found = index.matches(words_of(f"before {text} after".encode()), 0.8)
            assert [m.license for m in found] == [name] and found[0].coverage == 1 and found[0].start == 1
    mit = TEMPLATES["MIT"][1].replace("copy, modify", "copy and change, modify").replace("without restriction,", "")
    text = f"intro words. {mit} And Licensed under CC BY-NC 4.0."
    df = spark.createDataFrame([(1, text), (2, "the software is furnished to do so")], "doc_id long, text string")
    one, two = sorted(scan_licenses(df).collect(), key=lambda r: r["doc_id"])
    assert one["licenses"] == ["CC-BY-NC-4.0", "MIT"] and one["matches"][0]["coverage"] > 0.9 and two["n_matches"] == 0
    m = one["matches"][0]
    assert text[m["start_char"] : m["end_char"]].startswith("Permission") and text[m["start_char"] : m["end_char"]].endswith("Software")
    assert scan_licenses(hard).filter("n_matches > 0").count() == 0 and scan_licenses(df, templates={}).count() == 2


def test_short_notices_repeated_at_once_all_count():
    index = Index(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for text in texts:
            size = len(words_of(text.encode()))
            found = index.matches(words_of(f"before {text} {text} {text} after".encode()), 0.8)
            assert [(m.license, m.start, m.end) for m in found] == [(name, 1 + k * size, 1 + (k + 1) * size) for k in range(3)]


def test_license_lines_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = r"licensed under the GNU General Public License, version 3|Licensed under CC BY-NC 4\.0|Released under the MIT License|Licensed under the Apache License, Version 2\.0"
    want = docs.filter(F.col("text").rlike(lines)).count()
    assert scan_licenses(docs).filter("n_matches > 0").count() >= want > 0
