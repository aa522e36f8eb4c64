"""The training-data operators on small cases against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpusjobs.llm")

from corpusjobs.llm import chat, decontam, html_text, jaccard, media, packing, quality, suffix_tree, toxicity, warc  # noqa: E402
from corpusjobs.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", low(t)) if w]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, and columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "  \n "), (6, long), (6, long), (None, "one two three"), (8, "Été ÜBER %%% 1 <|endoftext|>"), (9, long + " end")]
    return spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, n long, key string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 6)) for i in range(1, 10)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def empty(df):
    return df.filter("false")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, odd, k, num, den):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for i, t in texts.items():
        w = spaced(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, k, num, den).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    rows = jaccard.join(odd, k, num, den).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in rows if r.doc_id in (6, 9)} == {6}
    assert jaccard.join(empty(odd), k, num, den).count() == 0
    assert sorted((r.doc_id for r in jaccard.keep_one(odd).collect() if r.doc_id), key=int) == [1, 3, 4, 5, 6, 8]


def test_keep_one_decides_by_row(spark):
    said = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(3, said(0, 50)), (5, said(0, 50)), (5, "other"), *((7, f"hot {i}") for i in range(40)), (None, "null"), (None, "null"), (None, "more"), (None, ""), (None, "")]
    rows += [(11, said(100, 200)), (None, said(110, 210)), (12, said(120, 220))]  # 11 and 12 are joined by the row between
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect())
    assert got == Counter({(3, rows[0][1]): 1, (5, "other"): 1, **{(7, f"hot {i}"): 1 for i in range(40)}, (None, "null"): 1, (None, "more"): 1, (None, ""): 1, (11, said(100, 200)): 1})
    assert {r.component_id for r in jaccard.join(docs, 5, 80, 100).collect() if r.doc_id in (11, 12)} == {11}


@pytest.mark.parametrize("block", [3, 7])
def test_jaccard_in_blocks(spark, block):
    """Clusters of many blocks: chains that the hub doesn't reach, near copies of one text, and what only meets."""
    import random

    pick = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(f"c{i}" for i in range(k * 3, k * 3 + 60)) for k in range(25)]  # each is linked with its neighbours
    near = [" ".join(w if pick.random() > 0.02 else f"x{pick.random()}" for w in base) for _ in range(40)]
    other = [" ".join(base[:30] + [f"y{k}{i}" for i in range(30)]) for k in range(12)]
    texts = chain + near + other
    pick.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(58)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rule = jaccard.Rule(3, 80, 100)
    own = jaccard.classes(docs, rule).cache()
    node = {r.doc_id: r.node for r in own.collect()}
    got = {r.node: r.root for r in components(jaccard.links(docs, own, rule, block=block)).collect()}
    label = {i: got.get(node[i], node[i]) for i in node}
    for i in range(len(texts)):
        for j in range(i):
            assert (label[i] == label[j]) == (find(i) == find(j))


def test_light_sets(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:n]) for n in range(1, 40)] + [" ".join(words[1:n]) for n in range(5, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, num, den in ((1, 80, 100), (1, 90, 100), (2, 75, 100)):
        rule = jaccard.Rule(k, num, den)
        sets = [{tuple(t.split()[j : j + k]) for j in range(len(t.split()) - k + 1)} if len(t.split()) >= k else {tuple(t.split())} for t in texts]
        for x in (1, *rule.boundaries()):
            keys = [set(jaccard.keys_of(np.unique(np.array([zlib.crc32(repr(e).encode()) for e in s], np.uint64)), rule, x).tolist()) for s in sets]
            for i in range(len(sets)):
                for j in range(i):
                    both = len(sets[i] & sets[j])
                    if sets[i] != sets[j] and den * both >= num * len(sets[i] | sets[j]):
                        assert keys[i] & keys[j], (k, num, x, i, j)
    assert jaccard.join(docs).count() == len(texts)


def test_fm_index():
    rng = np.random.default_rng(1)
    for n, top in ((1, 2), (50, 3), (400, 5), (300, 40)):
        text = rng.integers(1, top, n)
        index = decontam.FMIndex(text)
        patterns = np.full((30, 5), -1)
        lengths = rng.integers(1, 6, 30)
        for k, m in enumerate(lengths):
            patterns[k, 5 - m :] = rng.integers(1, top + 1, m)
        lo, hi = index.search(patterns, lengths)
        for k, m in enumerate(lengths):
            want = [i for i in range(n - m + 1) if (text[i : i + m] == patterns[k, 5 - m :]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_decontamination(spark, odd):
    items = [(1, "one two three"), (1, "five six"), (2, None), (3, "..."), (None, "ber"), (4, " ".join(f"w{i}" for i in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find(odd, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (6, 5, 1, True)
    assert got[1].items_sha256 == hashlib.sha256(b"1").hexdigest() and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[3].n_words, got[3].n_hit, got[3].contaminated) == (0, 0, False)
    assert [tuple(s) for s in got[1].spans] == [(0, 13), (19, 27)]
    assert len(decontam.blocks_of(bench, 13, 40)[1]) > 1
    assert sorted(map(str, decontam.find(odd, bench).collect())) == sorted(map(str, decontam.find(odd, bench, block_bytes=40).collect()))
    assert {r.text for r in decontam.cut_spans(odd, bench).collect() if r.doc_id == 1} == {" four "}
    kept = decontam.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and 1 not in {r.doc_id for r in kept.collect()}
    clash = odd.select("doc_id", "text", F.lit(5).alias("contaminated"), F.lit("x").alias("spans"), F.lit(1).alias("n_words"), F.lit(2).alias("c0"), F.lit(3).alias("__text"))
    for own in (decontam.drop_contaminated(clash, bench), decontam.cut_spans(clash, bench)):
        assert own.columns == clash.columns and {tuple(r)[2:] for r in own.collect()} == {(5, "x", 1, 2, 3)}
    assert decontam.find(clash, bench).filter("contaminated").count() == decontam.find(odd, bench).filter("contaminated").count()
    assert decontam.find(empty(odd), bench).count() == 0 and decontam.find(odd, empty(bench)).filter("contaminated").count() == 0


def test_media(spark, odd, tmp_path):
    rows = media.media_columns(media.store(odd, f"file://{tmp_path}"), f"file://{tmp_path}").collect()
    want = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == 10
    for r in rows:
        raw = want[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.width == 64 and r.height * 64 == len(payload)
    assert media.media_columns(media.store(empty(odd), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


def test_media_members_and_features(spark, odd, tmp_path):
    """The shards' members, read as plain tar files and decoded by hand, and the features of their samples."""
    import statistics
    import tarfile

    folder = f"file://{tmp_path}"
    catalog = media.store(odd.repartition(3), folder)
    members = {}
    for shard in tmp_path.glob("*.tar"):
        with tarfile.open(shard) as tar:
            for m in tar:
                members[m.name.removesuffix(".png")] = tar.extractfile(m).read()
    rows = media.media_columns(catalog, folder).collect()
    assert {r.digest for r in rows} == set(members) and not list(tmp_path.glob(".shard*"))
    for r in rows:
        png = members[r.digest]
        at, data = 8, b""
        while at < len(png):
            n = int.from_bytes(png[at : at + 4], "big")
            data += png[at + 8 : at + 8 + n] if png[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        lines = zlib.decompress(data)
        payload = b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65))
        assert hashlib.sha256(payload).hexdigest() == r.payload_sha256 == r.digest
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        share = [sum(b >> 4 == k for b in payload) / len(payload) for k in range(16)] if len(payload) < 10_000 else None
        if share:
            assert r.feature == f"mean={statistics.fmean(payload):.4f};std={statistics.pstdev(payload):.4f};hist=" + ",".join(f"{x:.5f}" for x in share)
    told = media.canonical(catalog).collect()
    assert {r.digest for r in told} == set(members) and sum(r.n_rows for r in told) == 10


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id <> 6 and doc_id is not null").selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = packing.pack(docs.repartition(5), path, fan_in=2).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d in docs.collect():
        ids, at = np.array(tok.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in p) < 2048 for p in seq.values()) <= 1
    assert packing.pack(empty(odd), path).count() == 0 and packing.pack(odd, path).select("doc_id").distinct().count() == 9


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers_own(name):
    import random

    import public_tokenizers

    own = packing.WordIds(public_tokenizers.path(name), most=40)
    chars = [chr(c) for c in range(0x3000) if not 28 <= c < 32]
    texts = [f"a{c}1 {c} x{c}{c}" for c in chars] + ["", "Don't <|endoftext|> x", "a\x1cb c", "\u0130stanbul \ufb01 \u03a3\u03b1\u03c2 \u039f\u0394\u039f\u03a3 e\u0301 \u304b\u3099", "a" * 300 + " b"]
    pick = random.Random(1)
    pool = "aAbB1\u00b2'\"\u00e9\u00c9\u00df\u01c5\u0130.,\u2014\u03a3\u03c2\u0301\u0345\u3042\u4e00\U0001f600\ua7da\u1c89\u0558\xad\u200b\x85\xa0\x7f  \n\t<|>stvem"
    texts += ["".join(pick.choices(pool, k=pick.randint(0, 30))) for _ in range(1000)]
    for text, ids in zip(texts, own.of(texts)):
        assert ids.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_warc(spark, tmp_path):
    page = "<p>" + "x" * 200
    rows = [(3, "http://a/\r\nb", page, 1), (1, "u", page, 1), (1, "u", page, 1), (2, None, page, 1), (4, "u", None, 1), (5, "u", "", 1), (6, "u", "short", 1), (7, "u", "short", 1), (None, "u", page, 1), (9, "u", "é" * 90_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    folder = f"file://{tmp_path}"
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(1, "response", None): 2, (2, "revisit", 1): 1, (3, "revisit", 1): 1, (None, "revisit", 1): 1, **{(i, "response", None): 1 for i in (4, 5, 6, 7, 9)}})
    want = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r.payload_digest == hashlib.sha256(want[r.page_id]).hexdigest() and r.payload_bytes == len(want[r.page_id]) for r in got)
    assert warc.read_archives(warc.write_archives(empty(pages), folder + "/e"), folder + "/e").count() == 0


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div><article><h1>Head &amp; tail</h1><p>One\n  two<br>three<p><b>Four<!-- no --></article><section id=comments><article class=comment>Nice</article></section><footer>F</footer>"
    assert html_text.main_text(page) == "Head & tail\nOne two three\nFour"
    assert html_text.main_text("") == ""
    long = "word " * 40
    plain = f"<body><div class=menu>A</div><div>{long}</div><div>short</div><div>{long}</div><div class=ad>Buy</div></body>"
    assert html_text.main_text(plain) == f"{long.strip()}\nshort\n{long.strip()}"
    rows = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>a", 1), (2, "u", "<p>a", 1), (2, "u", "<p>a", 1), (3, "u", "<nav><a", 1)], "page_id long, url string, html string, text long")
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in html_text.extract(rows).collect()) == [(0, "a", 1), (1, "", 0), (2, "a", 1), (2, "a", 1), (3, "", 0)]
    assert html_text.extract(empty(rows)).count() == 0


def test_html_raw_text():
    said = "word " * 40
    for odd in ("<script>for(i=0;i<n;i++){f('a')}</script>", "<script>a<!--b</script>", "<SCRIPT>x='</p>'</Script >", "<style>a<b{}</style>", "<div><button>x</div>", "<div><svg><g></div>", "<p><select><option>x</p>", "<button>x", "<noscript>x", "<template>x", "<button>x</div><div>", "<div><object><b>x</object></div>"):
        assert html_text.main_text(f"<body>{odd}<article><p>{said}</p></article><p>x</button>") == said.strip(), odd
        assert said.strip() in html_text.main_text(f"<body>{odd}<div>{said}</div>"), odd
    assert html_text.main_text("<p>One <select><option>x<option>y</select> two <svg><title>z</title><path/></svg>three") == "One two three"
    assert html_text.main_text("<p>One</p><script>two<p>three</p>") == "One"


def test_html_noisy_names():
    said, more = "word " * 40, "more " * 30
    for tag in ("div class='has-sidebar'", "div class=no-sidebar", "div class='with-banner'", "div class='page-header-fixed header'", "form id=aspnetForm", "section id=widget-area", "div role=form"):
        name, junk = tag.split()[0], f"<div class=sidebar>{more}</div><div class=related><article><p>teaser</article></div>"
        for body in (f"<article><p>{said}</article>", f"<div><p>{said}</div>"):
            assert html_text.main_text(f"<body><{tag}>{body}{junk}</{name}>") == said.strip(), (tag, body)
    assert html_text.main_text(f"<article><div class='entry-header'><h1>Head</h1></div><div class=share>Share</div><p>{said}<form>Mail</form></article>") == f"Head\n{said.strip()}"
    assert html_text.main_text(f"<body class=comments-open><article><p>{said}</article><div id=comments><article class=comment>{more * 9}</article></div>") == said.strip()
    assert html_text.main_text(f"<article><p>Short</article><div class=cookie-notice>{more}</div>") == "Short"
    assert html_text.main_text(f"<div class=popup>{said}</div>") == said.strip()


def test_html_windows():
    said = "word " * 40
    body = "".join(f"<p>{said}</p>" for _ in range(8))
    cards = "".join(f"<article><h3><a href=/>Card {i}</a></h3><p>A teaser of some words</p></article>" for i in range(4))
    assert html_text.main_text(f"<div>{body}</div><div>{cards}</div>") == "\n".join([said.strip()] * 8)
    links = "".join(f"<p><a href=/>Link {i}</a></p>" for i in range(5))
    assert html_text.main_text(f"<div>{links}</div><div>{said}</div><div>{links}</div>") == said.strip()
    assert html_text.main_text(f"<p>{said}<article><h1><a href=/>Head</a></h1><p>{said}</p><p>End</article>") == f"Head\n{said.strip()}\nEnd"


def test_html_reads_tags_as_browsers_do():
    said = "word " * 40
    art = f"<article><p>{said}</p></article>"
    for odd in ("<script>if(i<n){s=\"don't\"}</script>", "<style>a{content:'<b'}</style>", "<p>x<y and \"z</p>", "<a title=it's>x</a>", "<img alt=\"a>b\">", "<b title='>x</b>"):
        assert html_text.main_text(odd + art) == said.strip(), odd
    assert html_text.main_text("<article><p class='share price'>The share price<p class='comment-on-law'>The law<p>x <math><mi>a</mi></math> <object>b</object> <svg><title>t</title><text>c</text></svg> d<p class=ad>Buy</article>") == "The share price\nThe law\nx a b c d"
    assert html_text.main_text("<article>" + "<p><b>a<br>" * 5000 + "</article>") == "\n".join(["a"] * 5000)
    assert html_text.main_text("<div>" * 20_000 + "x") == "x"


def test_html_surge_and_dive():
    said, menu = "word " * 15, "<nav><ul><li><a href=/>Home</a><li><a href=/>News</a><li><a href=/>More</a></ul></nav>"
    page = f"<div>{said}</div><div>end</div>{menu}<div>tiny</div>{menu}<div>{said}</div><div class=ad>Buy</div><div>bye</div>"
    whole = said.strip()
    assert html_text.main_text(page) == f"{whole}\nend\n{whole}\nbye"  # one line without length doesn't part a stretch
    assert html_text.main_text(page, window=1) == f"{whole}\nend\n{whole}"  # here it does
    assert html_text.main_text(page, window=4) == f"{whole}\nend\ntiny\n{whole}\nbye"
    assert html_text.main_text(page, surge=1) == f"{whole}\nend\ntiny\n{whole}\nbye"
    assert html_text.main_text(page, surge=10**9) == f"{whole}\nend"


def test_html_equals_a_plain_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        """The lines of the article, on the given pages' simple markup."""

        def __init__(self, page):
            super().__init__(convert_charrefs=True)
            self.lines, self.text, self.depth = [], "", 0
            self.feed(page)
            self.close()
            self.line()

        def line(self):
            if said := " ".join(self.text.split()):
                self.lines.append(said)
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "h2", "li", "div", "article"):
                self.line()
            self.depth += tag == "article"
            self.text += " " * (tag == "br")

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "h2", "li", "div", "article"):
                self.line()
            self.depth -= tag == "article"

        def handle_data(self, data):
            self.text += data if self.depth else ""

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text == "\n".join(Plain(r.html or "").lines), r.page_id


def test_chat(spark):
    log = [(1, 1, 1, "delta", "user", "hi"), (1, 2, 2, "delta", "assistant", "a"), (1, 3, 2, "delta", "assistant", "b"), (1, 4, 2, "regenerate", "assistant", "c"), (1, 5, 2, "delta", "assistant", "<d>"), (1, 6, 1, "edit", "user", "#\\h"), (1, 7, 3, "delta", "user", "x"), (1, 8, 3, "delete", "user", None), (2, 1, 1, "delta", None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(events))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "#\\h"), ("assistant", "c<d>")] and back[1].loss == ["c<d>"]
    assert [tuple(t) for t in back[2].turns] == [("", "")]
    assert chat.render(chat.fold_events(empty(events))).count() == 0


def test_chat_of_odd_rows(spark):
    """Null ids, turns, roles and texts, repeated turns and empty tables, and extra columns named like outputs."""
    rows = [(1, 2, "user", "b"), (1, None, "user", "first"), (1, 2, "assistant", "a: </turn> ### x"), (1, 2, "assistant", "a: </turn> ### x"), (1, 3, None, None), (None, 0, "assistant", "n\\h"), (None, 1, "a:b", ""), (2, 0, "user", "w " * 50_000)]
    own = spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, formatted string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.log_of(own)))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "first"), ("assistant", "a: </turn> ### x"), ("assistant", "a: </turn> ### x"), ("user", "b"), ("", "")]
    assert back[1].loss == ["a: </turn> ### x"] * 2 and back[2].turns[0].text == "w " * 50_000 and back[2].loss == []
    assert [tuple(t) for t in back[None].turns] == [("assistant", "n\\h"), ("a:b", "")] and len(back) == 3
    assert chat.render(chat.fold_events(chat.log_of(empty(own)))).count() == 0


def test_toxicity_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts, toxic = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}

    def features(t):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", low(t).encode())
        return {(0, w) for w in words} | {(k, w[:k]) for w in words for k in range(3, 9) if len(w) > k}

    own = {i: features(t) for i, t in texts.items()}
    sample = [i for i in toxic if i in own and zlib.crc32(str(i).encode()) % 3 != 1]
    n, t = Counter(f for i in sample for f in own[i]), Counter(f for i in sample if toxic[i] for f in own[i])
    p = sum(toxic[i] for i in sample) / len(sample)
    z = {f: (t[f] - n[f] * p) / (n[f] * p * (1 - p)) ** 0.5 for f in n if t[f] >= 3}
    vocabulary = sorted(f for f in z if z[f] >= toxicity.LEAST_Z)
    got_vocabulary, model = toxicity.fit(docs, labels)
    assert 3 < len(vocabulary) == len(got_vocabulary) < toxicity.FEATURES
    x = np.array([[f in own[i] for f in vocabulary] for i in sample], np.float32)
    strength, y = x.sum(axis=1), np.array([toxic[i] for i in sample])
    cuts = np.quantile(strength[y == 1], [1 / 3, 2 / 3])
    plain = toxicity.CumulativeLink(x, np.where(y == 1, 1 + np.searchsorted(cuts, strength, "right"), 0), 3)
    assert (np.diff(plain.theta) > 0).all() and np.allclose(sorted(plain.w), sorted(model.w), atol=0.05)
    for r in toxicity.grade(docs, labels).collect():
        above = 1 / (1 + np.exp(plain.theta - sum(plain.w[k] for k, f in enumerate(vocabulary) if f in own[r.doc_id])))
        assert abs(r.p_toxic - above[0]) < 0.02 and abs(r.severity - above.sum()) < 0.05 and r.toxic == (r.p_toxic >= 0.5)
        assert r.grade == np.argmax(-np.diff([1, *above, 0])) or np.ptp(np.sort(-np.diff([1, *above, 0]))[-2:]) < 0.05


def test_cumulative_link_descends_the_likelihood():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 6)) < 0.4).astype(np.float32)
    grade = np.clip((x @ np.array([2, 1, 1, 0, 0, -1]) + rng.normal(0, 0.5, 300)).round(), 0, 3).astype(int)
    model = toxicity.CumulativeLink(x, grade, 3, decay=0)

    def loss(w, theta):
        above = 1 / (1 + np.exp(theta - (x @ w)[:, None]))
        return -np.log(np.where(grade[:, None] > np.arange(3), above, 1 - above)).sum(axis=1).mean()

    best = loss(model.w, model.theta)
    for k in range(6):
        for step in (-0.2, 0.2):
            assert loss(model.w + step * np.eye(6)[k], model.theta) > best
    assert all(loss(model.w, model.theta + s) > best for s in (-0.2, 0.2))


def test_quality_features_equal_plain_ones(spark):
    """Context sums and pooled features, from the buckets of words and shapes, by loops."""
    from corpusjobs.llm.common import pieces, utf8

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    texts, index = [r.text for r in docs.select("text").collect()] + [None, " \n", "Ab ab AB12 12 %% %% \u00e9\u00e9"], quality.index_vectors()
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    vectors = quality.word_vectors(rows)
    import pyarrow as pa

    items, sums, own = {}, np.zeros((quality.ITEMS, quality.SIZE)), []
    for t in texts:
        ((_, _, data, off),) = pieces(*utf8(pa.array([t], pa.string())))
        word, shape, _ = quality.items_of(data, off)
        said = spaced(t)
        assert len(word) == len(said) == len(shape)
        for w, k in zip(said, word):
            assert items.setdefault(w, k) == k  # equal words, equal buckets
        own.append((word, shape))
        for i in range(len(word)):
            for j in range(max(0, i - 2), min(len(word), i + 3)):
                if i != j:
                    sums[word[i]] += index[word[j]] + index[shape[j]]
                    sums[shape[i]] += index[word[j]] + index[shape[j]]
    assert (np.abs(index).sum(axis=1) <= 4).all()
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    want = np.where(length > 0, sums / np.where(length == 0, 1, length), 0)
    want[length[:, 0] > 0] -= want[length[:, 0] > 0].mean(axis=0)
    assert np.allclose(vectors, want, atol=1e-5)
    for t, (word, shape) in zip(texts, own):
        ((_, _, data, off),) = pieces(*utf8(pa.array([t], pa.string())))
        got = quality.pooled(data, off, vectors)[0]
        if not len(word):
            assert not got.any()
            continue
        a, b = vectors[word], vectors[shape]
        assert np.allclose(got, np.concatenate([a.mean(0), a.std(0), b.mean(0), b.std(0), [np.log1p(len(word)), np.linalg.norm(a.mean(0))]]), atol=1e-3)


def test_output_names_may_be_input_names(spark, odd, labels):
    clash = odd.select("doc_id", "text", *(F.lit(i).alias(c) for i, c in enumerate(("score", "predicted", "held_out", "grade", "toxic", "y", "x", "h", "__text", "node", "component_id", "n_shingles", "sequence_id", "start", "length", "digest", "shard", "offset", "n_tokens", "run", "__node"))))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    rest = tuple(range(len(clash.columns) - 2))
    assert same(quality.classify(clash, labels), quality.classify(odd, labels)) and same(toxicity.grade(clash, labels), toxicity.grade(odd, labels))
    for kept in (quality.classify(clash, labels, keep=True), toxicity.grade(clash, labels, keep=True), jaccard.keep_one(clash)):
        assert kept.columns == clash.columns and {tuple(r)[2:] for r in kept.collect()} <= {rest}
    assert same(jaccard.join(clash), jaccard.join(odd))
    assert same(suffix_tree.score(clash, F.lit(False)), suffix_tree.score(odd, F.lit(False)))
    number = clash.withColumn("text", F.lit(12345))
    assert quality.classify(number, labels, keep=True).columns == clash.columns == jaccard.keep_one(number).columns


def test_shared_folders(spark, tmp_path):
    from corpusjobs.llm import common

    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://x", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError):
        common.shared_dir(Cluster, "x")
    with common.passing():
        df = common.table_of(spark.range(3), "x")
        folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        import os

        assert df.count() == 3 and os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_one_row_of_a_labelled_id_is_fitted(spark):
    from corpusjobs.llm.common import labelled_sample

    docs = spark.createDataFrame([(2, f"t{i % 3}") for i in range(50)] + [(3, "u")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", 100, 1, 1).groupBy("doc_id").count().filter("count > 1").count() == 0


def test_classifiers(spark, odd, labels):
    got = quality.classify(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality.classify(odd, empty(labels)).collect())
    assert quality.classify(empty(odd), labels).count() == 0
    assert quality.classify(odd, labels, keep=True).columns == odd.columns
    assert len(toxicity.grade(odd, labels).collect()) == 10 and toxicity.grade(empty(odd), labels).count() == 0
    assert toxicity.grade(odd, empty(labels), keep=True).count() == 10
    docs, own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r for r in own.collect()}
    held = [(r.predicted, truth[r.doc_id].quality) for r in quality.classify(docs, own).collect() if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    held = [(int(r.toxic), truth[r.doc_id].toxic) for r in toxicity.grade(docs, own).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_suffix_tree(spark, odd):
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: [*spaced(r.text), None] for r in docs.collect()}
    count = Counter(w for i, own in words.items() if i % 5 for w in own)
    n, v = sum(count.values()), len(count)
    for r in suffix_tree.score(docs, F.col("doc_id") % 5 == 0).collect():
        own = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0
    assert suffix_tree.score(odd, F.lit(False)).count() == 10
    assert suffix_tree.score(odd, F.lit(True)).count() == 10 and suffix_tree.score(empty(odd), F.lit(False)).count() == 0


def test_suffix_tree_equals_a_plain_one(spark):
    """Scores of a tree in one part and in many against dicts; states rise with the input; held-out texts gain by contexts."""
    import math

    depth, least = 4, 12
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).cache()
    said = {r.doc_id: b"".join(w.encode() + b" " for w in spaced(r.text)) + b"\0" for r in docs.collect()}
    count = [defaultdict(Counter) for _ in range(depth + 1)]
    for i, t in said.items():
        if i % 5:
            t = bytes(depth) + t
            for at in range(depth, len(t)):
                for d in range(depth + 1):
                    count[d][t[at - d : at]][t[at]] += 1
    used = {c for c in count[0][b""]} | {0, 32}

    def p(context, symbol):
        """The smoothed distribution, whether the context is retained or not."""
        own = count[len(context)][context]
        if not context:
            n = sum(own.values()) + 0.5 * 256
            return (own[symbol] + 0.5) / n
        return (own[symbol] + len(own) * p(context[1:], symbol)) / (sum(own.values()) + len(own))

    kept = {b""}
    for d in range(1, depth + 1):
        for context, own in count[d].items():
            n = sum(own.values())
            if n >= least and sum(m * math.log(m / n / p(context[1:], c)) for c, m in own.items()) > len(own):
                kept |= {context[k:] for k in range(d)}
    want = {}
    for i, t in said.items():
        t, total = bytes(depth) + t, 0.0
        for at in range(depth, len(t)):
            total += math.log10(p(next(t[at - d : at] for d in range(depth, -1, -1) if t[at - d : at] in kept), t[at]))
        want[i] = total
    for part_contexts in (10**6, 200):
        rows = suffix_tree.score(docs, F.col("doc_id") % 5 == 0, depth, least, part_contexts).collect()
        assert len(rows) == len(said) and all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-5) for r in rows)
    forest = [suffix_tree.fit(docs.filter(f"doc_id < {n} and doc_id % 5 <> 0").select("text"), depth, least, k) for n, k in ((30, 10**6), (10**9, 10**6), (10**9, 200))]
    assert forest[0].states < forest[1].states == len(kept) and forest[2].parts > 5
    held = [r for r in rows if r.held_out and r.n_tokens > 50]
    root = {i: sum(math.log10(p(b"", c)) for c in t) for i, t in said.items()}
    assert len(used) > 20 and len(held) > 3 and all(r.score > root[r.doc_id] for r in held)


def test_suffix_tree_of_many_short_texts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        docs = spark.range(0, 70_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit(1).alias("score"))
        r = suffix_tree.score(docs, F.lit(False)).agg(F.count("*"), F.min("n_known"), F.max("train_tokens"), F.countDistinct("base_score")).first()
        assert tuple(r) == (70_000, 2, 140_000, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suffix_tree_sums_to_one():
    code = np.array([c | (p << 8) for p in (0, 97, 98, 32) for c in (97, 98, 32, 0)], np.int64)
    n = np.arange(1, 17, dtype=np.int64) * 50
    root = np.array([0, 32, 97, 98], np.int64)
    tree = suffix_tree.SuffixTree.build([(root, np.array([50, 60, 70, 80], np.int64)), (np.sort(code), n)])
    for row in tree.logs[1:]:
        p = 10.0 ** row.astype(float)
        assert abs(p[:-1].sum() + p[-1] * tree.unseen - 1) < 1e-5


def thue_morse(n):
    """Two different words of n letters a and b whose polynomial sums modulo 2**64 are equal for any base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomials_confuse(spark):
    x, y = thue_morse(2048)
    docs = spark.createDataFrame([(1, f"one two {x}"), (2, f"one two {y}"), (3, f"one two {x}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(7, y)], "item_id long, text string")
    assert [r.doc_id for r in decontam.find(docs, items).collect() if r.n_hit] == [2]
    told = suffix_tree.score(docs.filter("doc_id <> 3"), F.col("doc_id") == 2).collect()
    assert {r.doc_id: r.n_known for r in told} == {1: 4, 2: 3}


def test_word_hashes():
    """Hashes tell words by their bytes alone, whatever stands beside them, at all lengths about eight bytes."""
    from corpusjobs.llm.common import SPACE_WORDS, Words, utf8

    import pyarrow as pa

    words = [w * k for w in ("a", "b", "ab", "é", "\x00") for k in range(1, 40)] + ["a" * 5000, "a" * 4999 + "b", "b" + "a" * 4999]
    own = Words(*utf8(pa.array([" ".join(words), " ".join(words[::-1]), *words])), SPACE_WORDS)
    n = len(words)
    assert len(own.h) == 3 * n and len(set(own.h[:n].tolist())) == len(set(words))
    assert (own.h[:n] == own.h[n : 2 * n][::-1]).all() and (own.h[:n] == own.h[2 * n :]).all()


def test_packing_large_ids_beside_nulls(spark):
    docs = spark.createDataFrame([(None, "one two"), (2**53 + 1, "three four"), (2**53 + 3, None)], "doc_id long, text string").repartition(3)
    import public_tokenizers

    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in got} == {None, 2**53 + 1, 2**53 + 3}


def test_html_ends_of_articles():
    long = "A paragraph that is long enough to be the text of the page, and goes on for some time. " * 3
    aside = "<aside><p>one</p><p>two</p><p>three</p><p>four</p></aside>"
    advert = '<div class="ad"><p>Buy</p><p>this</p><p>now</p></div>'
    text = long.strip()
    menu, foot = "<nav><ul><li>Home</li><li>News</li><li>Shop</li><li>More</li></ul></nav>", "<footer><p>Terms</p><p>Privacy</p><p>Imprint</p></footer>"
    page = lambda body: f"<html><body>{menu}{body}{foot}</body></html>"
    assert html_text.main_text(page(f"<article><p>{long}</p>{aside}<p>Thanks for reading.</p></article>")) == text + "\nThanks for reading."
    assert html_text.main_text(page(f"<div><p>{long}</p>{advert}<p>The end.</p></div>")) == text + "\nThe end."
    assert html_text.main_text(page(f"<div><p>By me.</p>{advert}<div><p>{long}</p></div></div>")) == "By me.\n" + text
    assert html_text.main_text(f"<body>{menu}<p>{long}</p>{advert}<p>The end.</p>{foot}</body>") == text + "\nThe end."
    assert html_text.main_text(page(f"<div><p>{long}</p></div>") + "<p>Stray</p>") == text


def test_decontamination_reads_blocks_once_for_many_shards(spark, monkeypatch):
    """With several blocks, each is read once for all shards that are held, not once for each shard."""
    import pyarrow as pa

    from corpusjobs.llm import common

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(40))) for i in range(60)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(k, " ".join(f"w{(k * 11 + j) % 50}" for j in range(15))) for k in range(12)], "item_id long, text string")
    whole = sorted(map(str, decontam.find(docs, items).collect()))
    folder, blocks = decontam.blocks_of(items, 13, 60)
    assert len(blocks) >= 3
    monkeypatch.setattr(decontam, "pieces", lambda data, off: common.pieces(data, off, 200))  # a shard for every document
    read = []
    monkeypatch.setattr(decontam, "block", lambda f, k, own=decontam.block: (read.append(k), own(f, k))[1])
    monkeypatch.setattr(decontam, "blocks_of", lambda *_: (folder, blocks))
    task = {}

    class Frame:
        def __init__(self, df):
            self.df, self.columns = df, df.columns

        def toDF(self, *names):
            out = self.df.toDF(*names)
            out.mapInArrow = lambda f, schema: task.update(f=f)
            return out

    decontam.marked(Frame(docs), items)
    batch = docs.toArrow().rename_columns(["c0", "c1"]).combine_chunks().to_batches()
    rows = [r for b in task["f"](batch) for r in b.to_pylist()]
    assert sorted(read) == sorted(blocks)
    monkeypatch.undo()
    got = sorted(map(str, decontam.find(docs, items, block_bytes=60).collect()))
    assert got == whole and len(rows) == 60 and any(r["n_hit"] for r in rows)


def test_packing_remembers_little():
    import sys

    import public_tokenizers

    words, texts = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")), (" ".join(f"w{k:x}" for k in range(lo, lo + 1000)) for lo in range(0, 400_000, 1000))
    assert sum(len(ids) for ids in words.of(texts)) > 400_000
    held = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (words, words.older))
    assert held < 45e6
