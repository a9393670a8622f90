"""Packing, token files, sampled pieces, page text and fixity: round trips and brute force."""

import html
import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probcast.llm import fixity, html_text, packing, piece_sampling, rans
from probcast.llm.tokens import TextEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "  two  spaces ", "tab\tline\n\nend\n", "It's  they'RE ''s", "éÉ×÷ 日本 　x\x85y z", "9Ⅷ9 a1,b;c",
       "<|endoftext|> <|startoftext|>", "▁a ▁▁ b", "\x00\x1c", "x" * 5000, "word " * 20_000, "😀 ñ́"]


def noise(rng, n):
    alphabet = list(" \n\t'sS,.!aAzZéÉ×9#<|>́  　") + ["'re", " the"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("path,keep", [(BYTE, True), (WORDS, False)])
def test_chunked_ids_equal_library_ids(path, keep):
    encoder = TextEncoder(path, keep)
    texts = ODD + noise(random.Random(1), 3000)
    for start in range(0, len(texts), 500):
        part = texts[start:start + 500]
        ids, bounds = encoder.encode(pa.array(part, pa.string()))
        want = encoder.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)
        for i, w in enumerate(want):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == w.ids, repr(part[i])[:80]


@pytest.mark.parametrize("path,keep", [(BYTE, True), (WORDS, False)])
def test_special_strings_equal_untouched_library(path, keep):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(path), random.Random(11)
    some = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext |>", "<|endof", "text|>", "<|", "|>", " ", "\n\n",
            "  ", "a", "It's", "'s", "É", "9", "\u0338", "\u3000", ".", " see"]
    texts = ["see <|endoftext|> here", "<|endof", "text|>", None, "<|endoftext|>" * 3]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    ids, bounds = TextEncoder(path, keep).encode(pa.array(texts, pa.string()))
    for i, w in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == w.ids, repr(texts[i])
    assert ids[:bounds[1]].tolist() == ([3826, 220, 50256, 994] if keep else [862, 49407, 763])


def test_packing_and_token_files_use_untouched_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "a b"), (2, "see <|endoftext|> here"), (3, "<|startoftext|>x<|endoftext|>"), (4, "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def crc(ids):
        return zlib.crc32(np.array(ids, "<u4").tobytes())

    want = {i: Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    got = {r["id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_texts(df, BYTE, 2).collect()}
    assert got == {i: (len(ids), crc(ids)) for i, ids in want.items()}
    rans.write_token_files(df, f"file://{tmp_path}/special", WORDS, 1)
    at = 0
    for r in rans.read_token_files(spark, f"file://{tmp_path}/special").orderBy("start").collect():
        ids = Tokenizer.from_file(WORDS).encode(dict(rows)[r["id"]], add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_encoder_cache_shrinks(monkeypatch):
    import probcast.llm.tokens as module

    monkeypatch.setattr(module, "CACHE_CHUNKS", 60)
    encoder, rng = TextEncoder(BYTE, True), random.Random(2)
    for _ in range(30):
        text = " ".join(rng.choice(["common", "usual", f"rare{rng.random()}"]) for _ in range(25))
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_uses_every_token_once(spark):
    rng = random.Random(3)
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(100 + i, "w " * rng.randint(0, 150), "clash") for i in range(150)]
    rows += [(None, "no key", "clash"), (5, ODD[5], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    capacity = 64
    got = packing.pack_texts(df, BYTE, 2, capacity, keep_ids=True).collect()
    encoder = TextEncoder(BYTE, True)
    want = sorted(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["id"]].append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(map(len, want))
    assert sum(r["length"] for r in got) == total
    assert len(sequences) <= math.ceil(total / capacity) * 1.02 + 1
    seen = []
    for key, own in pieces.items():
        copies = 2 if key == 5 else 1
        own.sort(key=lambda r: r["piece"])
        if copies == 1:
            assert [r["piece"] for r in own] == list(range(len(own)))
            assert all(r["length"] == capacity for r in own[1:])
            seen.append(np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist())
    assert all(s in want for s in seen)


def test_fullest_combination_equals_exhaustive_search():
    from itertools import product

    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(4)}
        lengths = sorted(counts)
        best = max((sum(n * x for n, x in zip(pick, lengths)) for pick in product(*(range(counts[x] + 1) for x in lengths))
                    if pick[-1] >= 1 and sum(n * x for n, x in zip(pick, lengths)) <= 25), default=0)
        found = packing.fullest_combination(dict(counts), 25)
        assert sum(n * x for x, n in found.items()) == best and max(lengths) in found
        assert all(n <= counts[x] for x, n in found.items())


def test_packing_empty_table(spark):
    assert packing.pack_texts(spark.createDataFrame([], "doc_id long, text string"), BYTE, 2).count() == 0


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(5)
    options = rans.CodecOptions(bits=14, lanes=8, block_tokens=64)
    ids = np.minimum(rng.geometric(0.05, 1000), 300).astype(np.uint32)
    codec = rans.Codec(rans.quantised(np.bincount(ids), options.bits), options)
    for n in (0, 1, 7, 8, 63, 64, 65, 1000):
        image = codec.encode(ids[:n])
        assert codec.decode(image).tolist() == ids[:n].tolist()
    blocks = codec.blocks(image)
    assert codec.decode_blocks(blocks[3:4])[0].tolist() == ids[192:256].tolist()  # blocks stand alone
    with pytest.raises(ValueError):
        codec.decode(image[:-3] + b"\x00\x01\x02")
    probability = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(probability * np.log2(probability)).sum() * len(ids) / 8
    payload = sum(4 * len(b[3]) for b in blocks)
    assert payload < entropy * 1.1 + 1


def test_quantised_frequencies():
    for counts in ([1], [0, 5, 0, 1], [10**9] + [1] * 900, list(range(1000))):
        freq = rans.quantised(np.array(counts), 10)
        assert freq.sum() == 1024 and ((freq > 0) == (np.array(counts) > 0)).all()
    with pytest.raises(ValueError):
        rans.quantised(np.ones(2000, int), 10)


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, t, "x") for i, t in enumerate(ODD + noise(rng, 60))] + [(None, "null key", "x"), (3, "repeated", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    options = rans.CodecOptions(block_tokens=256, segment_tokens=500)
    rans.write_token_files(df, f"file://{tmp_path}/files", WORDS, 1, options=options)
    got = rans.read_token_files(spark, f"file://{tmp_path}/files", options).orderBy("start").collect()
    keys = [r["id"] for r in got]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k) and len(got) == len(rows)
    tokenizer, at = TextEncoder(WORDS, False).tokenizer, 0
    want = defaultdict(list)
    for k, t, _ in rows:
        want[k].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = np.frombuffer(bytes(r["tokens"]), "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids in want[r["id"]]
        assert r["ids_crc32"] == zlib.crc32(bytes(r["tokens"]))
        at += len(ids)


def test_token_files_empty(spark, tmp_path):
    rans.write_token_files(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", WORDS, 1)
    assert rans.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_sampled_pieces_are_lossless_and_repeatable(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD + noise(random.Random(7), 100))] + [(None, "no key", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    one = {r["id"]: r for r in piece_sampling.sample_segmentations(df, PIECES).collect()}
    two = {r["id"]: r for r in piece_sampling.sample_segmentations(df.repartition(5), PIECES).collect()}
    assert len(one) == len(rows) and all(r["lossless"] for r in one.values())
    assert all(bytes(one[k]["ids"]) == bytes(two[k]["ids"]) for k in one)
    back = piece_sampling.decode_ids(piece_sampling.sample_segmentations(df, PIECES), PIECES)
    assert {r["id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t, _ in rows}
    assert piece_sampling.sample_segmentations(df.limit(0), PIECES).count() == 0


def test_sampled_pieces_follow_the_path_weights():
    options = piece_sampling.SamplingOptions(sharpness=0.5)
    vocabulary = piece_sampling.PieceVocabulary(PIECES, options)
    piece = {b: i for i, b in enumerate(vocabulary.bytes) if i >= 259 and b}

    def paths(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            if (i := piece.get(text[:k].encode())) is not None:
                for rest, w in paths(text[k:]):
                    yield (i, *rest), w + vocabulary.weight[i]

    known = dict(paths(" there"))
    total, n = sum(map(math.exp, known.values())), 60_000
    ids, bounds = piece_sampling.sample_ids(pa.array([" there"] * n), list(range(n)), vocabulary, options)
    seen = defaultdict(int)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        seen[tuple(ids[a:b].tolist())] += 1
    assert set(seen) <= set(known)
    for path, w in known.items():
        p = math.exp(w) / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p / n) + 1e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><a href=x>Home</a> <a href=y>News</a></nav><div class="ad">Buy now, buy a lot of it today.</div>
<article><h1>Head &amp; line</h1><p>First   <b>bold</b> &lt;text&gt;<br>next.<p>Second.</p>
<div class="related-links"><a href=1>other</a></div><p>x</p></article>
<section id="comments"><p>I read this and I liked it so much that I wrote a long comment about it.</p></section>
<footer>&copy; 2020</footer></body></html>"""


def test_page_text():
    tree = html_text.grow_tree(html_text.EXAMPLES)
    assert all(tree.decide(row) == bool(row[-1]) for row in html_text.EXAMPLES)
    assert html_text.main_text(PAGE, tree) == "Head & line\n\nFirst bold <text> next.\n\nSecond.\n\nx"
    paragraph = "long words in a row that make up a paragraph of plain text without any links at all "
    plain = (f'<body><div class="menu"><a>a</a><a>b</a></div><div><p>{paragraph}</p><p>{paragraph * 2}</p></div>'
             f'<div id="sidebar"><p>{paragraph}</p></div></body>')
    assert html_text.main_text(plain, tree) == f"{paragraph.strip()}\n\n{(paragraph * 2).strip()}"


ARTICLE = "<article><h1>Head line</h1><p>Some plain words of text.</p></article>"


@pytest.mark.parametrize("page", [
    "<html><head><title>T</title><body>{}", "<html><head><title>T</title><meta charset=x>{}", "<head><title>T<body>{}",
    "<head><style>p{{}}</style><noscript>x<body>{}", "<HEAD><script>var a='<p>';</script><title>T</title></HEAD><body>{}",
    *[f"<body><{t} class=x>{{}}</body>" for t in "noscript template svg iframe object canvas".split()],
    *[f"<body><{t}><p>gone</p></{t}>{{}}</body>" for t in "noscript template svg iframe object canvas script style".split()],
    "<body>{}<script>var a", "<body>{}<style>p", "<body>{}<!-- <p>gone</p>", "<body><svg/>{}"])
def test_page_text_of_unclosed_elements(page):
    tree = html_text.grow_tree(html_text.EXAMPLES)
    assert html_text.main_text(page.format(ARTICLE), tree) == "Head line\n\nSome plain words of text."


def test_text_after_an_unclosed_head():
    assert [b.text for b in html_text.page_blocks("<head><title>T</title> Plain text")] == ["Plain text"]
    assert html_text.page_blocks("<head><title>T") == []


@pytest.mark.parametrize("page", [
    '<div class="content has-sidebar">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="hasSidebar">{}</div>',
    '<div class="elementor-widget-text-editor">{}</div>', '<form action="x"><input type=hidden>{}</form>',
    '<div class="category-legal with-menu">{}</div>'])
@pytest.mark.parametrize("article", [True, False])
def test_page_text_in_marked_wrappers(page, article):
    tree = html_text.grow_tree(html_text.EXAMPLES)
    some = ["Plain words that fill " + "one more line of a paragraph " * n for n in (9, 12, 8)]
    body = "".join(f"<p>{t}</p>" for t in some)
    body = f'<article class="post tag-legal">{body}</article>' if article else body
    assert html_text.main_text(page.format(body), tree) == "\n\n".join(t.strip() for t in some)


def test_page_text_overrules_names_only():
    tree = html_text.grow_tree(html_text.EXAMPLES)
    long = "words of a long text without any links " * 20
    assert html_text.main_text(f'<div class="widget"><p>{long}</p></div>', tree) == long.strip()
    assert html_text.main_text(f'<div id="related"><main><p>Few words.</p></main></div>', tree) == "Few words."
    for page in (f"<aside><p>{long}</p></aside>", f"<div hidden><p>{long}</p></div>", "<main><div class=widget>Few words.</div></main>",
                 "<main><form>Your name <input> and mail</form></main>", f'<div class="widget"><a href=x>{long}</a></div>',
                 f"<footer><article><p>{long}</p></article></footer>"):
        assert html_text.main_text(page, tree) == "", page


def test_page_text_edges(spark):
    deep = "<div>" * 3000 + "<p>" + "deep words here " * 30 + "</p>"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<article><p>cut &am"), (4, None, "<article><p>1 < 2 <foo"), (None, "u", deep),
            (6, "u", "<article>" + "<p>a b</p>" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[1]["n_chars"] == 0
    assert got[3]["text"] == "cut &am" and got[4]["text"] == "1 < 2" and "deep words" in got[None]["text"]
    assert got[6]["text"] == "\n\n".join(["a b"] * 5000) and got[6]["n_chars"] == len(got[6]["text"])
    assert html_text.extract_text(df.limit(0)).count() == 0
    assert html.unescape("&amp") == "&"


def records(spark, rows):
    return spark.createDataFrame(rows, "file long, offset long, length long, hash string")


def test_audit_finds_exactly_the_damage(spark):
    rng = random.Random(8)
    rows, at = [], defaultdict(int)
    for i in range(3000):
        f = rng.randrange(40)
        size = rng.randint(100, 5000)
        rows.append((f, at[f], size, f"h{i}"))
        at[f] += size
    changed, missing = set(rng.sample(range(3000), 7)), set(rng.sample(range(3000), 5))
    other = [(f, o, n, h + "!" if i in changed else h) for i, (f, o, n, h) in enumerate(rows) if i not in missing]
    other.append((41, 0, 10, "new"))
    want = {(*rows[i][:3], "changed") for i in changed - missing} | {(*rows[i][:3], "missing") for i in missing} | {(41, 0, 10, "extra")}
    for leaf, fanout in ((1 << 14, 16), (1 << 10, 3)):
        got = fixity.audit(records(spark, rows), records(spark, other), leaf, fanout).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert fixity.root_hash(records(spark, rows)) == fixity.root_hash(records(spark, rows[::-1]))
    assert fixity.root_hash(records(spark, rows)) != fixity.root_hash(records(spark, other))


def test_audit_edges(spark):
    none, one = records(spark, []), records(spark, [(0, 0, 5, "a"), (0, 0, 5, "a")])
    assert fixity.audit(none, none).count() == 0 and fixity.audit(one, one).count() == 0
    assert [r["kind"] for r in fixity.audit(one, none).collect()] == ["missing"]
    assert [r["kind"] for r in fixity.audit(none, one).collect()] == ["extra"]


def test_records_and_layout(spark):
    df = spark.createDataFrame([(1, "http://a", "é"), (2, None, None), (2, "b", "")], "page_id long, url string, html string")
    raw = df.select(fixity.warc_record(F.col("url"), F.col("html")).alias("r")).collect()
    assert bytes(raw[0]["r"]) == ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a\r\nContent-Length: 2\r\n\r\né\r\n\r\n").encode()
    laid = fixity.lay_out(df, F.lit(0).cast("long"), ["page_id"], fixity.warc_record(F.col("url"), F.col("html"))).collect()
    assert sorted(r["offset"] for r in laid) == [0, len(bytes(raw[0]["r"])), len(bytes(raw[0]["r"])) + next(
        r["length"] for r in laid if r["offset"] == len(bytes(raw[0]["r"])))]


FURNITURE_MARKS = ['class="comments"', 'class="comment-body"', 'id="respond"', 'class="advert"', 'class="ad-container"', 'class="cookie-notice"',
                   'id="noticeBar"', 'class="sidebar"', 'class="left-sidebar"', 'id="footer"', 'class="site_footer"', 'class="main-menu"']


@pytest.mark.parametrize("mark", FURNITURE_MARKS)
@pytest.mark.parametrize("place", ["after", "before", "inside"])
@pytest.mark.parametrize("article", [True, False])
def test_long_furniture_by_a_plain_name_stays_out(mark, place, article):
    tree = html_text.grow_tree(html_text.EXAMPLES)
    some = ["Plain words that fill " + "one more line of a paragraph " * n for n in (20, 12)]
    other = f"<div {mark}><h3>More</h3><p>{'words that somebody else wrote at length ' * 30}</p></div>"
    first, last = (f"<p>{t}</p>" for t in some)
    wrap = "<article>{}</article>" if article else "<div>{}</div>"
    if place == "inside":
        page = wrap.format(first + other + last)
    else:
        text = wrap.format(first + last)
        page = text + other if place == "after" else other + text
    assert html_text.main_text(f"<body>{page}</body>", tree) == "\n\n".join(t.strip() for t in some)


def test_a_plain_name_around_the_article_ends_there():
    tree = html_text.grow_tree(html_text.EXAMPLES)
    assert html_text.main_text(f'<div class="sidebar main">{ARTICLE}</div>', tree) == "Head line\n\nSome plain words of text."
    teaser = "<div class=sidebar><article><h3>Other</h3><p>Words of another text.</p></article></div>"
    for page in (ARTICLE + teaser, teaser + ARTICLE):
        assert html_text.main_text(page, tree) == "Head line\n\nSome plain words of text."
    long = "words of a long text without any links " * 20
    assert html_text.main_text(f'<div class="sidebar-layout"><p>{long}</p></div>', tree) == long.strip()


def test_deep_pages_take_linear_time():
    tree = html_text.grow_tree(html_text.EXAMPLES)
    for deep in ("<div>" * 100_000, "<form><section class=x><li>" * 30_000, "<b class=comment>" * 50_000):
        page = deep + "<p>" + "words at the bottom of it all " * 40
        began = time.process_time()
        html_text.main_text(page + "</div>" * 50_000, tree)
        assert time.process_time() - began < 8
