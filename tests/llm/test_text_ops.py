"""Byte-level BPE, token counts, HTML extraction, language identification."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsglass.llm import bpe, html_text, langid, lyndon, token_counts

ODD_TEXTS = ["", " ", "\n\n\n", "a", "The cat's  hat\t\n x", "\x1c\x1d\x85\xa0  y", "naïve Ünï 中文 😀😀", "  lead", "tail  ", "don't 12345 !!??", "é́", "0" * 3000, "ab " * 2000, "x" * 20000]


@pytest.fixture(scope="module")
def encoder():
    return bpe.load(*bpe.public_vocabulary())


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(ODD_TEXTS)] + [(100, None, None, None, None), (None, "no id", "en", "s", 5), (3, "a", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("ids", F.lit(1)).withColumn("row", F.lit("x"))


def test_bpe_as_tiktoken(encoder):
    import tiktoken
    import public_tokenizers as P
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), 0x1680, 0x180E, 0x2003, 0x2028, 0x200B, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x660, 0x2160]]
    for text in ODD_TEXTS + ["".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(3000)]:
        ids = encoder.encode(text)
        assert ids == other.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_bpe_side_by_side_as_by_heap(encoder):
    rng = random.Random(3)
    words = [w for w in " the quick isn't naïve Ünï 中文 😀 anonerorreor schschstö".split(" ")] + ["ab", "aa", "\n", "é"]
    pieces = [b"x", b"ab"] + ["".join(rng.choices(words, k=rng.randint(1, 12))).encode()[:bpe.SHORT] or b"y" for _ in range(3000)]
    assert encoder.merge_many(pieces) == [np.array(encoder.merge(p), np.int32).tobytes() for p in pieces]
    assert encoder.merge_many([]) == []
    for seed in range(20):  # ranks in any order: a joined pair may make a lower one
        rng = random.Random(seed)
        longer = {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)}
        keys = [bytes([i]) for i in range(256)] + sorted(longer)
        rng.shuffle(keys)
        own = bpe.ByteBPE({k: r for r, k in enumerate(keys)}, r"\S+")
        pieces = [bytes(rng.choices(b"abc", k=rng.randint(1, 30))) for _ in range(300)]
        assert own.merge_many(pieces) == [np.array(own.merge(p), np.int32).tobytes() for p in pieces]


def test_bpe_byte_without_rank():
    ranks = {b"a": 0, b"b": 1, b"\xc3\xa9": 2, b"a\xc3\xa9": 3, b"ab": 4}
    own = bpe.ByteBPE(ranks, r"\S+")
    assert own.encode("abé aé abab é") == [4, 2, 3, 4, 4, 2]


def test_bpe_short_misses_take_no_heap(encoder, monkeypatch):
    own = bpe.ByteBPE(encoder.ranks, bpe.public_vocabulary()[1])
    heaped = []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda piece: heaped.append(piece) or merge(piece))
    text = " ".join(f"anonerorre{w}schschst" for w in ["ab", "é", "zq", "qq"]) + " " + "zxq" * 40
    assert own.encode(text) == encoder.encode(text)
    assert heaped == [b" " + b"zxq" * 40]


def test_bpe_frequent_words_stay(encoder, monkeypatch):
    own = bpe.ByteBPE(encoder.ranks, bpe.public_vocabulary()[1])
    monkeypatch.setattr(bpe, "MEMO_SIZE", 20)
    asked = []
    whole = own.whole
    monkeypatch.setattr(own, "whole", lambda piece: asked.append(piece) or whole(piece))
    rng = random.Random(4)
    for _ in range(200):
        text = "anonerorreor " + " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(4))
        assert own.encode(text) == encoder.encode(text)
        assert len(own.memo) + len(own.older) <= bpe.MEMO_SIZE + 10
    assert asked.count(b"anonerorreor") == 1


def test_bpe_texts_side_by_side(encoder):
    import pyarrow as pa
    col = pa.array(["skipped", *ODD_TEXTS, None, "é" * 700_000, "after"], pa.string()).slice(1)
    got = list(encoder.encode_column(col))
    assert [t for t, _ in got] == col.to_pylist()
    assert [x.tolist() for _, x in got] == [encoder.encode(t) for t in col.to_pylist()]
    assert list(encoder.encode_column(col.slice(0, 0))) == []


def test_perfect_hash_is_minimal():
    keys = [b"k%d" % i for i in range(997)]
    h = bpe.PerfectHash(keys)
    assert sorted(h(k) for k in keys) == list(range(997))
    assert bpe.PerfectHash([b"one"])(b"one") == 0


def test_bpe_query(spark, odd_docs, encoder):
    rows = bpe.encode_digests(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["exact"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    ids = encoder.encode(ODD_TEXTS[4])
    assert by[4]["n_tokens"] == len(ids)
    assert by[4]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert by[100]["n_tokens"] == 0 and by[100]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_digests(odd_docs.limit(0)).collect() == []
    full = {r["doc_id"]: r for r in bpe.encode(odd_docs).collect()}
    assert list(full[4]["ids"]) == ids and bytes(full[4]["decoded"]) == ODD_TEXTS[4].encode()


def test_token_counts_by_brute_force(encoder):
    rng = random.Random(2)
    for text in ODD_TEXTS[:10]:
        ids = encoder.encode(text)
        starts, at = [], 0
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        for i in ids:
            starts.append((owner[at], owner[at + len(encoder.token[i]) - 1] + 1))
            at += len(encoder.token[i])
        lengths = np.array([len(encoder.token[i]) for i in ids], np.int64)
        if not text:
            continue
        first, end = token_counts.spans(text, lengths)
        assert list(zip(first.tolist(), end.tolist())) == starts
        lo = np.array([rng.randint(0, len(text)) for _ in range(20)])
        hi = np.array([rng.randint(0, len(text)) for _ in range(20)])
        n, crossing = token_counts.attribute(first, end, lo, hi)
        for a, b, x, y in zip(lo, np.maximum(lo, hi), n, crossing):
            own = [(s, e) for s, e in starts if a <= s < b]
            assert (x, y) == (len(own), sum(e > b for _, e in own))


def test_token_counts_query(spark, odd_docs, encoder):
    rows = token_counts.token_counts(odd_docs).collect()
    for i, t in enumerate(ODD_TEXTS):
        own = [r for r in rows if r["doc_id"] == i]
        copies = sum(r["section"] == -1 for r in own)
        assert copies == (2 if i == 3 else 1)
        assert sum(r["n_tokens"] for r in own if r["section"] >= 0) == copies * len(encoder.encode(t))
        assert max(r["end"] for r in own) == len(t)
    cut = token_counts.token_counts(odd_docs.filter("doc_id = 7"), F.expr("array(named_struct('start', 0, 'end', 3), named_struct('start', 3, 'end', 99), null)")).collect()
    assert [r["section"] for r in cut] == [-1, 0, 1] and cut[0]["n_tokens"] == cut[1]["n_tokens"] + cut[2]["n_tokens"]
    assert token_counts.token_counts(odd_docs.limit(0)).collect() == []


def test_suffix_arrays():
    rng = random.Random(5)
    blocks = [[rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 60))] * rng.choice([1, 1, 3]) + [0] for _ in range(300)]
    sa = lyndon.suffix_arrays(np.array(sum(blocks, [])), np.array([len(b) for b in blocks]))
    at = 0
    for b in blocks:
        assert (sa[at:at + len(b)] - at).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        at += len(b)


PAGES = [
    ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">buy this now</div>'
     '<article><h1>Big &amp; small</h1><p><b>First <i>wor</i>ds of the text.<br><p>a &lt;b&gt; c</p></article><footer>&copy; me</footer></body></html>',
     "Big & small First words of the text. a <b> c"),
    ('<div class="sidebar">one two</div><div class="post"><h1>Title</h1><p>Hello world of words</p><div class="ad">buy now</div><p>more text here</p></div>'
     '<section id="comments"><p>nice article really</p></section><form>email <input></form>', "Title Hello world of words more text here"),
    ("plain text only", "plain text only"),
    ("<p>one <p>two <a hre", "one two"),
    ("<nav>only a menu</nav>", ""),
    ("", ""),
    (None, ""),
    ("<div>a<script>x<y</script>b</div><p title=\"a>b\">text", "a b text"),
    ("<!-- c --><article>x</article", "x"),
    ("<article><p>kept words here</p><aside>related</aside><p>and   these\n too</p></article><div class='cookie-notice'>We use cookies</div>", "kept words here and these too"),
]


def test_main_text(spark):
    weights = html_text.Weights({}, {})
    for page, text in PAGES:
        assert html_text.extract(page, weights) == text
    rows = [(i, f"http://h/{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, None, None, None), (0, "http://h/0", PAGES[0][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None:
            assert r["text"] == PAGES[r["page_id"]][1] and r["n_chars"] == len(r["text"])
    assert html_text.main_text(pages.limit(0)).collect() == []


BLOCKS = ['<aside>{}</aside>', '<div class="advert"><p>{}</p></div>', '<div class="related-posts"><ul><li><a href="/x">{}</a></li></ul></div>', '<form><label>{}</label><input></form>',
          '<section id="comments"><div><p>{}</p></div></section>', '<button>{}</button>', '<aside><div class="ad">{}</div></aside>']


@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="post">{}</div>', "<div>{}</div>", "{}", '<div class="c1"><section>{}</section></div>'])
@pytest.mark.parametrize("block", BLOCKS)
def test_main_text_on_both_sides_of_a_block(frame, block):
    """Blocks longer than the text beside them, in mid-article, before the last and after the first paragraph."""
    weights = html_text.Weights({}, {})

    def text(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    for sizes in ((500, 50), (50, 500), (20, 20), (200, 30, 30)):
        for long in (10, 60, 400):
            parts = [text("abcdefgh"[j], n) for j, n in enumerate(sizes)]
            inside = block.format(text("junk", long)).join(f"<p>{p}</p>" for p in parts)
            page = ("<html><head><title>t</title></head><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav>" + frame.format(inside)
                    + "<footer>all rights reserved by the owner</footer></body></html>")
            assert html_text.extract(page, weights) == " ".join(parts)


def test_main_text_keeps_blocks_outside_apart():
    """Boilerplate beside the content still cuts off the loose words behind it."""
    weights = html_text.Weights({}, {})
    body = " ".join(f"w{i}" for i in range(100))
    menu = "<nav><ul>" + "<li><a>menu entry</a></li>" * 8 + "</ul></nav>"
    for content in (f"<article><p>{body}</p></article>", f"<div><p>{body}</p></div>"):
        assert html_text.extract(f"<body><div>Welcome to us</div>{menu}{content}<aside>more of this and that</aside><div>Powered by it</div></body>", weights) == body


def test_main_text_long(spark):
    long = "<article>" + "<p>some words &amp; more</p>" * 20000 + "</article>"
    assert html_text.extract(long, html_text.Weights({}, {})) == " ".join(["some words & more"] * 20000)


def test_langid_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 100
    assert all(0 <= r["score"] <= 1 for r in got)


def test_langid_cases(spark, odd_docs):
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in langid.identify(odd_docs).collect()}
    assert {(0, "und", False), (1, "und", False), (100, "und", False), (11, "und", False), (4, "en", True), (None, "en", True)} <= got
    assert langid.identify(odd_docs.limit(0)).collect() == []
    blank = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(blank).collect()} == {"und"}


def test_langid_rejects_far_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "ψψψψ ωωωω ξξξξ ζζζζ")], "doc_id long, text string")
    assert langid.predict(odd, model, reject=True).first()["lang_pred"] == "und"
    assert langid.predict(odd, model).first()["far"]
