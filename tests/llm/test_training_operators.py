"""Operators against brute force, libraries, round trips and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from gridframe.llm import decontaminate, html_text, language, license_rules, licenses, line_dedup, nearest, pieces, quality, queries, simhash, token_ids
from gridframe.llm.common import read_table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


# ------------------------------------------------------------ 1, 6: held-out accuracy


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, larger):
    got = quality.query(spark, larger).join(read_table(spark, larger, "labels"), "doc_id").where("held_out").select("predicted", "quality", "score").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    good, bad = got.score[got.quality == 1], got.score[got.quality == 0]
    assert good.mean() > bad.mean() + 0.5


def test_quality_reads_whole_texts():
    rng = random.Random(3)
    start = "".join(rng.choices("abcdefgh ", k=1 << 16))
    plain, varied = "a" * (1 << 18), "".join(rng.choices("abcdefgh ", k=1 << 18))
    assert quality.features(start + plain)[-2] < quality.features(start + varied)[-2] / 2


def test_language_held_out(spark, larger):
    docs = read_table(spark, larger, "documents")
    got = language.query(spark, larger).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_language_spans(spark, larger):
    docs = read_table(spark, larger, "documents")
    model = language.fit(docs)
    german, spanish = (docs.where(f"lang = '{k}' and n_chars between 200 and 2000").first()["text"].split()[:30] for k in ("de", "es"))
    spans = model.spans(" ".join(german + spanish))
    assert [s[2] for s in spans] == ["de", "es"] and abs(spans[0][1] - 30) <= 2


def test_viterbi_is_best_path(spark):
    rng = np.random.default_rng(3)
    table = np.log(rng.dirichlet(np.ones(3), 40))
    table[0] = 0
    ids = rng.integers(1, 40, (7, 1))
    got = language.LanguageModel.viterbi(table, ids, np.array([7]))[:, 0]
    import itertools

    def cost(path):
        return sum(table[i, k] for i, k in zip(ids[:, 0], path)) - language.SWITCH * sum(a != b for a, b in zip(path, path[1:]))

    assert abs(cost(got) - max(map(cost, itertools.product(range(3), repeat=7)))) < 1e-9


# ------------------------------------------------------------ 2: pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">Accept</div><!-- <p>x</p> -->
<article><h1>Head&amp;line</h1><p>First <b>bold</b>
 text&nbsp;&#233;<br>next<p>Second<ul><li>one<li>two</ul><aside>See also</aside><div class="ad">Buy</div><form><input><button>Go</button></form><p class='x'>Last &lt;tag&gt;</p>
<section class="comments"><p>Nice!</p></section></article><div id="sidebar"><p>Side</p></div><footer>&copy; x</footer></body></html>"""


def kinds(page):
    found = html_text.blocks(page)
    return [[t for k, t in found if k == kind] for kind in (html_text.CONTENT, html_text.LOOSE)]


def test_html_blocks():
    assert kinds(PAGE) == [["Head&line", "First bold text é next", "Second", "one", "two", "Last <tag>"], []]


@pytest.mark.parametrize(
    "page, content, loose",
    [
        ('<article><h1>T</h1></article><div class="content"><p>Long body</p></div>', ["T"], ["Long body"]),
        ('<article class="search-engines menu"><p>x y</p></article>', ["x y"], []),
        ('<main><div class="related-work"><p>RW</p></div><p class="notice">N</p><p>z</p></main>', ["z"], ["RW", "N"]),
        ("<nav><a>Menu<article><p>a</p></article>", ["a"], []),
        ('<main><p>b</p><ol class="comment-list"><li><article class="comment-body"><p>Nice</p></article></ol></main>', ["b"], []),
        ('<article>foo <span class="ad">buy</span> bar <b>c</b></article>', ["foo bar c"], []),
        ('<article><p>x</p></article><div class="cookie-note">a</div><div id="sidebar">s</div>', ["x"], []),
        ('<p>one</p><div class="cookie-note">a</div><div class="cookie-notice">b</div>', [], ["one", "a"]),
        ('<div role="main"><p>x</p></div><div role="navigation">n</div>', ["x"], []),
        ("<aside><article>teaser</article></aside><article>text</article>", ["text"], []),
        ("<nav><article>menu card</article></nav><main>text</main>", ["text"], []),
        ('<div id="comments"><article>a comment</article></div><div class="post">text</div>', [], ["text"]),
        ('<div id="comments"><div><article>a comment</article></div></div><article>text</article>', ["text"], []),
        ('<article>one</article><div class="reader-comments"><article>nested comment</article></div>', ["one"], []),
        ('<article>one<ul class="commentlist"><li>c</ul><div class="post-comments">d</div><div class="userComments">e</div></article>', ["one"], []),
        ('<article>one<div class="no-comments commentary">two</div><p class="has-comments">three</p></article>', ["one"], ["two", "three"]),
        ("<aside><div><article>teaser</article></div><aside>x</aside></aside><nav><main>text</main>", ["text"], []),
        ("<header><header><article>a</article></header>", [], []),
        ("<form><div><main><p>x</p></main></div>", ["x"], []),
    ],
)
def test_html_zones(page, content, loose):
    assert kinds(page) == [content, loose]


def brute_text(rows, min_tokens=html_text.MIN_TOKENS, min_pages=html_text.MIN_PAGES, long_tokens=html_text.LONG_TOKENS, share=html_text.HOST_SHARE):
    """Texts by looking at every substring of every stream."""
    import math
    from collections import defaultdict

    host = lambda url: url.split("/")[2]
    sizes, where = defaultdict(set), defaultdict(set)
    for url, page in {(host(u), p) for _, u, p in rows}:
        words = html_text.outside(html_text.blocks(page)).split(" ")
        if words == [""]:
            continue
        sizes[url].add(page)
        for a in range(len(words)):
            for b in range(a + min_tokens, len(words) + 1):
                if html_text.GAP not in words[a:b]:
                    where[url, tuple(words[a:b])].add(page)
    out = {}
    for page_id, url, page in rows:
        found = html_text.blocks(page)
        words = html_text.outside(found).split(" ")
        gone = set()
        for a in range(len(words)):
            for b in range(a + min_tokens, len(words) + 1):
                n = len(where.get((host(url), tuple(words[a:b])), ()))
                if n >= min_pages and (b - a >= long_tokens or n >= math.ceil(share * len(sizes[host(url)]))):
                    gone.update(range(a, b))
        text, at, seen = [], 0, html_text.CONTENT
        for kind, block in found:
            if kind == html_text.CONTENT:
                text.append(block)
            else:
                at += at > 0 and seen == html_text.CONTENT
                left = [w for k, w in enumerate(block.split(" "), at) if k not in gone]
                at += len(block.split(" "))
                if kind == html_text.LOOSE and left:
                    text.append(" ".join(left))
            seen = kind
        out[page_id] = "\n\n".join(text)
    return out


def test_html_suffixes_brute(spark):
    """Covered tokens are those of all repeated substrings."""
    rng = random.Random(4)
    notices = [" ".join(rng.choices("abcdefgh", k=rng.randrange(3, 40))) for _ in range(8)]
    rows = []
    for k in range(150):
        body = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(notices).split() if rng.random() < 0.5 else rng.choices(["x", "y", "z", f"own{k}"], k=rng.randrange(1, 12))
            body.append(rng.choice(["<div>{}</div>", "<nav>{}</nav>", "<article><p>{}</p></article>", '<p class="notice-x">{}</p>']).format(" ".join(words)))
        rows.append((k, f"http://h{k % 7 // 5}.example/{k}", "".join(body)))
    rows += [(k + 500, url, page) for k, url, page in rows[:9]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for options in ({}, {"min_tokens": 4, "min_pages": 2, "long_tokens": 8, "host_share": 0.2}, {"min_tokens": 6, "min_pages": 3, "long_tokens": 6, "host_share": 1.0}):
        got = {r["page_id"]: r["text"] for r in html_text.main_text(frame, **options).collect()}
        names = {"host_share": "share"}
        assert got == brute_text(rows, **{names.get(k, k): v for k, v in options.items()}), options


def test_html_suffixes(spark, monkeypatch):
    """Runs cross block ends, unique runs of a block stay, and a shuffle decides as a broadcast does."""
    notice = "Subscribe today for all the news from our friendly team"
    own = {k: " ".join(f"word{k * j}x" for j in range(3, 15)) + f" page {k}" for k in range(5)}
    rows = [(k, f"http://h.example/{k}", f"<body><div>{notice}</div><p>{own[k]}</p><p>{notice} tail{k}</p><div>All</div><div>our</div><div>small</div><div>menu</div><div>items</div><div>here</div></body>") for k in range(5)]
    rows += [(9, "http://other.example/1", f"<body><p>{notice}</p></body>"), (10, "http://other.example/1", f"<body><p>{notice}</p></body>"), (11, "http://other.example/1", f"<body><p>{notice}</p></body>")]
    for limit in (html_text.MAX_BROADCAST, -1):
        monkeypatch.setattr(html_text, "MAX_BROADCAST", limit)
        got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(got[k] == f"{own[k]}\n\ntail{k}" for k in range(5))
        assert got[9] == got[10] == got[11] == notice


def test_html_long_page(spark):
    page = "<main>" + "".join(f"<p>paragraph {k} of a very long page</p>" for k in range(30_000)) + "</main><div>" + "word " * 50_000 + "</div>"
    got = html_text.main_text(spark.createDataFrame([(1, "http://h.example/", page, "x", "y")], "page_id long, url string, html string, host string, page string")).collect()
    assert len(got) == 1 and got[0]["text"].count("\n\n") == 30_000 and got[0]["n_chars"] == len(got[0]["text"])


# ------------------------------------------------------------ 3: token shards


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 1000, 1_000_000], list(range(0, 5000, 3)), [7] * 700 + [10**12]])
def test_elias_fano(values):
    low_bits, low, high = token_ids.ef_encode(np.array(values, dtype=np.uint64))
    ef = token_ids.EliasFano(len(values), low_bits, low, high)
    assert ef.all().tolist() == values == [ef.select(i) for i in range(len(values))]
    assert len(low) + len(high) <= len(values) * (2 + low_bits) // 8 + 2 + (values[-1] >> low_bits if values else 0) // 8


def test_shards(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = read_table(spark, sf_dir, "documents")
    tok = Tokenizer.from_file(token_ids.word_bpe_path())
    want, start = [], 0
    for doc_id, text in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    shards = token_ids.write_shards(docs, token_ids.word_bpe_path(), partitions=3, shard_ids=5000)
    assert sorted(map(tuple, token_ids.read_documents(shards).collect())) == want
    assert sorted(map(tuple, token_ids.read_documents(shards, max_broadcast=0).collect())) == want
    shard = token_ids.Shard(shards.orderBy("part", "seq").first()["shard_bytes"])
    assert len(shard.document(2)) == want[2][2] and shard.offsets(2)[0] == want[2][1]


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_ids.word_bpe_path())
    enc = token_ids.encoder(token_ids.word_bpe_path())
    texts = ["Hello, World. don't WE'LL it's", "É́ é H̱ İstanbul ΣΑΣ ς ﬁ", "<|endoftext|> x<|EndOfText|> <|startoftext|>a", "a,b. c., d.) (e. f),g 3.5, 2,000. x_y.", "tab\tnew\nline\r\n\x0b\x1c nbsp x　y", "中文。 ok, Ñandú. ÇA. ß.", ""]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aB cé,.'s\ńΣ<|%3_") for _ in range(60)) for _ in range(300)]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, enc.kind).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_any_tokenizer_is_the_library(spark, sf_dir):
    """A tokenizer that looks across words gets whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), token_ids.encoder(path)
    assert not isinstance(enc, token_ids.WordEncoder) and isinstance(token_ids.encoder(token_ids.word_bpe_path()), token_ids.WordEncoder)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    want = {r["doc_id"]: zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 50256], "<u4").tobytes()) for r in docs.collect()}
    got = {r["doc_id"]: r["ids_crc32"] for r in token_ids.read_documents(token_ids.write_shards(docs, path, end_id=50256)).collect()}
    assert got == want
    texts = ["Hello there, World. New York", "a  b\n\n c", "", "É́ <|endoftext|>"]
    assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


# ------------------------------------------------------------ 4: leaks

ITEM = "Natalia sold 48 clips to her friends in April and then she sold half as many clips in May for 3 km"


def test_leaks(spark):
    swapped = ITEM.replace("Natalia", "Robert").replace("48", "96").replace("3 km", "7 miles")
    broken = "Robert sold 48 clips to her friends in June and then she sold half as many clips in Karl for 3 km"
    docs = [(1, "Before it. " + ITEM + " After."), (2, "Intro text. " + swapped.upper().lower()), (3, "Once more. " + swapped), (4, "nothing of the kind is in here at all, only words"), (5, ITEM.split(" her ")[0]), (6, broken)]
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()}
    assert {1, 3} <= set(got) and not {4, 5} & set(got)
    assert got[1]["n_exchanged"] == 0 and got[3]["n_exchanged"] >= 2 and got[1]["item_id"] == 7


def test_leaks_in_tables(spark, larger):
    """Every document that holds an item word for word is found."""
    words = lambda t: " ".join((t or "").lower().split())
    items = [words(r["text"]) for r in read_table(spark, larger, "benchmark").collect()]
    want = {r["doc_id"] for r in read_table(spark, larger, "documents").collect() if any(i in words(r["text"]) for i in items)}
    got = {r["doc_id"] for r in decontaminate.query(spark, larger).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(got)


# ------------------------------------------------------------ 5, 7


def test_line_runs(spark):
    short = ["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx", "yz", "aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    long = "a line that is certainly longer than fifty characters in all"
    rows = [(1, "\n".join([*short, long])), (2, "\n".join(["own", *short, "end"])), (3, f"x\n{long}\ny"), (4, "ab\ncd")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own\nend", 3: "x\ny", 4: "ab\ncd"}


def brute_runs(rows, min_chars):
    """Lines in any run, of any length, that is long enough and has an earlier copy."""
    texts = {i: t.split("\n") for i, t in rows}
    seen, gone = {}, set()
    for i in sorted(texts):
        for a in range(len(texts[i])):
            for b in range(a + 1, len(texts[i]) + 1):
                run = tuple(texts[i][a:b])
                if sum(map(len, run)) + len(run) >= min_chars and seen.setdefault(run, (i, a)) < (i, a):
                    gone.update((i, k) for k in range(a, b))
    return {i: "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone) for i, lines in texts.items()}


@pytest.mark.parametrize("min_chars", [5, 12, 50])
def test_line_runs_brute(spark, min_chars):
    rng = random.Random(min_chars)
    rows = [(i, "\n".join(rng.choice(["", "a", "bb", "ccc", "d" * 7, "e" * 13, f"own{i}"]) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    rows += [(i + 100, t + "\n" + rows[3][1]) for i, t in rows[:8]]
    rows = [(i, t) for i, t in rows if t]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars).collect()}
    assert got == brute_runs(rows, min_chars)


def test_license_rules(spark):
    known = license_rules.SENTENCES
    text = f"Intro.\n{known['bsd grant']}:\nCopyright me.\n{known['bsd source'].upper()};\n{known['bsd binary']}.\nThen. Released under the MIT License. More."
    got = [(r["license"], r["n_sentences"]) for r in licenses.scan(spark.createDataFrame([(1, text), (2, "no licence here")], "doc_id long, text string")).orderBy("first_word").collect()]
    assert got == [("BSD-2-Clause", 3), ("MIT", 1)]


def test_license_anchors():
    import re

    assert all(re.search(licenses.ANCHORS, s) for s in license_rules.SENTENCES.values())
    assert all(re.search(licenses.ANCHORS, f"{p}{name}") for p in license_rules.PREFIXES for _, name in license_rules.PHRASES)
    assert {i for _, ids in license_rules.RULES for i in ids} == {*license_rules.SID.values(), *license_rules.NAME_SID.values()}


def test_license_gaps(spark):
    """Other sentences, also known ones, may stand between those of a rule, up to a number of words."""
    known = license_rules.SENTENCES
    near, far = ("filler words here. " * k for k in (30, 40))
    texts = {1: f"{known['mit grant']}. {near}Licensed under ISC. {known['mit notice']}.", 2: f"{known['mit grant']}. {far}{known['mit notice']}."}
    got = sorted((r["id"], r["license"], r["n_sentences"]) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect())
    assert got == [(1, "MIT", 2), (2, "MIT", 1)]


# ------------------------------------------------------------ 8: SimHash


def brute_fingerprint(text, words=4):
    import xxhash

    parts = [w for w in "".join(c.lower() if c.isascii() else c for c in text).translate({k: " " for k in range(9, 14)}).split(" ") if w]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").collect()
    texts = [r["text"] or "" for r in rows[:40]] + ["", "One", "a b c d", "Ä É x\ty", "x " * 700]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def brute_components(pairs):
    ids = [i for i, _ in pairs]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, fa) in enumerate(pairs):
        for b, fb in pairs[k + 1 :]:
            if (fa ^ fb).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_components(spark, larger):
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.query(spark, larger).collect()}
    want = brute_components(sorted((i, fp) for i, (fp, _) in got.items()))
    assert {i: c for i, (_, c) in got.items()} == want


def test_links_of_clusters():
    """Runs of every size give the same components as all pairs."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) % 2**64 for b in base for _ in range(90)})
    signed = np.array(fps, np.uint64).view(np.int64)
    a, b = simhash.run_links(np.zeros(len(signed), np.int64), signed, 4)
    edges = list(zip(a.tolist(), b.tolist()))
    want = brute_components([(int(s), int(f)) for s, f in zip(signed, fps)])
    root = {int(s): int(s) for s in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        x, y = sorted((find(x), find(y)))
        root[y] = x
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups({k: find(k) for k in root}) == groups(want)


# ------------------------------------------------------------ 9: pieces


@pytest.fixture(scope="module")
def model():
    return pieces.model(pieces.piece_path())


def library_ids(texts):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.piece_path()).encode(texts)


ODD_TEXTS = ["the " * 60, "a" * 150, "  a   b\n\n c ", "日本語のテキスト" * 20, "\n\n\n", "Thingonhe, ciónmente.\nQue ñ" * 9, "x" * 16 + " " * 40 + "y", "", " ", "=" * 90 + "\t" * 5, "\u2581a \u2581", "🙂é́" * 9]


@pytest.mark.parametrize("chunk_chars", [300, pieces.CHUNK_CHARS])
def test_ids_are_the_librarys(spark, larger, chunk_chars):
    """On every document, cut or whole."""
    docs = read_table(spark, larger, "documents").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in pieces.encode(docs, pieces.piece_path(), chunk_chars).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = dict(zip(texts, library_ids(list(texts.values()))))
    assert {i: np.frombuffer(r["ids"], "<u2").tolist() for i, r in rows.items()} == want
    assert all(r["n_tokens"] == len(want[i]) and r["text"] == texts[i] for i, r in rows.items())


def joined(model, normal, chunk):
    """Ids of a text through its chunks' matrices."""
    cut = list(model.cut(normal, chunk))
    if not cut:
        return b"", 0.0
    states, total = pieces.boundaries([pieces.loaded(pieces.dumped(model.transfer(*c))) for c in cut])
    return b"".join(model.backtrace(*c, states[k], states[k + 1]) for k, c in enumerate(cut)), total


@pytest.mark.parametrize("chunk", [7, 16, 33, 100, 32_768])
def test_chunks(model, chunk):
    rng = random.Random(chunk)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "the", "in", "er", "日", "é", "\n", ".", ",", "==", "-", "ing", "▁", "1", "\t", "S", "tion", "ñ"]
    texts = ODD_TEXTS + ["".join(rng.choices(parts, k=rng.randrange(1, 120))) for _ in range(300)] + ["thein" * 9000, "".join(rng.choices("abcdefghij", k=40_000))]
    for text, want in zip(texts, library_ids(texts)):
        ids, total = joined(model, model.normal(text), chunk)
        assert np.frombuffer(ids, model.kind).tolist() == want == np.frombuffer(model.encode(model.normal(text)), model.kind).tolist(), text
        assert total == 0 and (model.decode(ids) == text or "▁" in text)


def test_allowed_pairs(model):
    """Undoing merges agrees with merging the pair's joined text."""
    rng = random.Random(5)
    some = rng.sample(sorted(model.pieces), 600) + ["▁" * k for k in range(1, 17) if "▁" * k in model.pieces]
    for _ in range(20_000):
        a, b = rng.choice(some), rng.choice(some)
        assert model.allowed(a, b) == (model.merged(a + b)[0] == [a, b]), (a, b)


@pytest.mark.parametrize("chunk", [7, 33, 32_768])
def test_sum_model(chunk):
    """Read as a unigram model, the library finds no better sum."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(pieces.piece_path(), "rb") as file:
        m.ParseFromString(file.read())
    m.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    model = pieces.open_model(pieces.piece_path(), 1)
    for text in ["thingonhe", "Ciónmenteueó", "unbelievable,", "heißt", "aaaaaaaaaaaaaaaaa", "x.y(z);", "a b c", "don't stop", "Thingonhe, ciónmente.\nQue ñ" * 9]:
        want = model.score(np.array(library.encode(text), model.kind).tobytes())
        ids, total = joined(model, model.normal(text), chunk)
        assert abs(total - want) < 1e-3 and abs(model.score(ids) - want) < 1e-3 and model.decode(ids) == text


def test_scan_is_associative():
    rng = np.random.default_rng(1)
    mats = [rng.normal(size=(4, 4)) for _ in range(9)]
    left = mats[0]
    for m, p in zip(mats[1:], pieces.prefixes(mats)[1:]):
        left = pieces.combine(left, m)
        assert np.allclose(left, p)


def test_round_trip(spark, sf_dir, model):
    docs = read_table(spark, sf_dir, "documents")
    small = {r["doc_id"]: r for r in pieces.digest(docs, pieces.piece_path()).collect()}
    cut = {r["doc_id"]: r for r in pieces.digest(docs, pieces.piece_path(), chunk_chars=500).collect()}
    assert all(r["round_trip"] for r in [*small.values(), *cut.values()]) and max(r["n_chunks"] for r in cut.values()) > 1
    assert {i: r["score"] for i, r in small.items()} == {i: r["score"] for i, r in cut.items()}
    coded = pieces.decode(pieces.encode(docs, pieces.piece_path()), pieces.piece_path())
    assert coded.where("decoded <> text").isEmpty()


# ------------------------------------------------------------ 10: nearest


def brute_top(rows, queries_, k=5):
    """(query id, rank, id, score) of different (id, vector) rows, by integers."""
    rows = {(i, tuple(v)) for i, v in rows}
    out = []
    for i, q in {(i, tuple(v)) for i, v in queries_}:
        best = sorted({(-sum(int(a) * int(b) for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q)})[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("group_bytes, part_rows", [(1 << 25, 200_000), (2000, 150), (40_000, 1000)])
def test_pivot_search(spark, group_bytes, part_rows, monkeypatch):
    """Clusters, ties, repeated ids and two lengths, in any cut of groups and parts."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 8)) * 3
    rows = [(int(i), np.floor(256 * (centres[i % 9] + rng.normal(size=8) * 0.2)).tolist()) for i in rng.permutation(900)]
    rows += [(int(i) + 900, rows[7][1]) for i in range(40)] + [(i, v[:5]) for i, v in rows[:60]] + rows[:30]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    asked = frame.where("id % 20 = 0")
    want = brute_top(rows, [(i, v) for i, v in rows if i % 20 == 0])
    for most in (nearest.MAX_GROUPS, 0):
        monkeypatch.setattr(nearest, "MAX_GROUPS", most)
        got = nearest.top_k(frame, asked, group_bytes=group_bytes, part_rows=part_rows)
        assert sorted(map(tuple, got.collect())) == want


def test_pivots_exclude_rows():
    """On clustered rows far from all candidates are evaluated."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    rows = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.1))
    table = nearest.PivotTable(np.arange(500), rows[:500], float((rows**2).sum(axis=1).max()), 16)
    ids = np.arange(4000)
    finder = nearest.GroupSearch(ids[:50], rows[:50], table.distances(rows[:50], False), table.first_thresholds(ids[:50], rows[:50], 5), table.lift, 5)
    finder.meet(ids, rows, table.distances(rows, True))
    want = brute_top(list(zip(ids.tolist(), rows.tolist())), list(zip(ids[:3].tolist(), rows[:3].tolist())))
    assert [(n, r, int(i), int(s)) for n in range(3) for r, (i, s) in enumerate(zip(*finder.top[n]), 1)] == want
    assert finder.evaluated < 0.7 * 50 * 4000
