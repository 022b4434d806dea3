"""Each operator against brute force, exact round trips or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import extract, fuzzy, language, media, mixing, packing, quality, sharding, simhash, warc
from folioscan.llm.common import new_folder


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav><div class="ad">Buy {n}</div><article><h1>Title &amp; {n}</h1>
<p>First   <b>{n}<p>Second<br>line &lt;x&gt; 5 < 6</p><form>Name <input></form><script>var a="</p>";</script></article><div id="comments"><p>Nice {n}</p></div><aside class=sidebar>Side</aside><footer>&copy; {n}</footer>"""


def test_extract_blocks():
    want = "Title & {n}\nFirst {n}\nSecond line <x> 5 < 6"
    wrapper = extract.parse(PAGE.format(n=0))[0]
    for k in range(1, 4):
        extract.absorb(wrapper, extract.parse(PAGE.format(n=k))[0], False)
    extract.decide(wrapper)
    for k in range(4):
        assert extract.main_text(PAGE.format(n=k)) == extract.main_text(PAGE.format(n=k), wrapper) == want.format(n=k)
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<!-- x") == extract.main_text("<script>a") == ""
    assert extract.main_text("plain <b") == "plain"


def test_extract_without_semantic_tags():
    page = "<div id=top><a href=/>Home</a></div><div id=mid><h2>Story</h2><div><p>A long enough paragraph of text.</p><p>One more paragraph of text.</p></div></div><div id=bottom><ul><li><a>x</a></li></ul></div>"
    assert extract.main_text(page) == "Story\nA long enough paragraph of text.\nOne more paragraph of text."


def test_wrapper_folds_and_aligns():
    a = extract.parse("<ul><li>1<li>2<li>3</ul><p>x")[0]
    b = extract.parse("<ul><li>1</ul><div class=k>new</div><p>y")[0]
    assert a.kids[0].kids[0].repeated and len(a.kids[0].kids) == 1
    extract.absorb(a, b, False)
    assert [(k.label, k.optional) for k in a.kids] == [("ul", False), ("div.k", True), ("p", False)]
    assert a.kids[2].text is None  # a slot
    assert extract.load(a.dump()).dump() == a.dump()


def test_extract_of_deep_pages(spark):
    deep = ["<div>" * 100_000 + "<p>far down", "<li>" * 50_000 + "x" + "</ul></p>" * 1000, "<table><tr><td>" * 5000 + "cell", "</div>" * 100_000 + "<p>a", "<p>" * 100_000 + "one", "<blockquote><div>" * 20_000 + "q" + "</blockquote>" * 20_000 + "<p>end"]
    want = ["far down", "x", "cell", "a", "one", "q\nend"]
    assert [extract.main_text(p) for p in deep] == want
    data = [(k, f"https://h/{k}", p) for k, p in enumerate(deep)] + [(10 + k, f"https://g{k}/", p) for k, p in enumerate(deep)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    for sent in (1 << 30, 0):
        got = {r.page_id: r.text for r in extract.extract(df, sent_bytes=sent).collect()}
        assert [got[10 + k] for k in range(6)] == want and len(got) == 12
    node = extract.parse("<div>" * 3000 + "a")[0]
    assert extract.load(node.dump()).dump() == node.dump()


def unlabelled(k, rng):
    """A page whose tags and classes tell nothing, and its article."""
    sentence = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)) + "."
    title, body = sentence(5), [sentence(rng.randint(8, 30)) for _ in range(rng.randint(1, 5))]
    notice = "<table><tr><td>This site keeps small files on your device so that the pages you see are the pages you like, and we ask you to agree to that before you go on reading what is here.</table>"
    end = "<div><div>Every word on these pages was written by people whom we pay, so please think about whether a few coins a month could find their way from your purse to ours.</div></div>"
    html = f"<html><body><div><div><a href=/>Home</a> <a href=/a>All</a></div>{notice}<div><h2>{title}</h2>" + "".join(f"<p>{x}</p>" for x in body) + f"</div>{end}</div></body></html>"
    return html, "\n".join([title, *body])


def test_the_wrapper_tells_the_template_from_the_article(spark):
    rng = random.Random(12)
    pages = [unlabelled(k, rng) for k in range(12)]
    df = spark.createDataFrame([(k, f"https://same.org/{k}", h) for k, (h, _) in enumerate(pages)], "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    assert [got[k] for k in range(12)] == [t for _, t in pages]
    assert all(extract.main_text(h) != t for h, t in pages)  # the page alone doesn't tell
    # copies of one page are no template
    df = spark.createDataFrame([(k, f"https://copies.org/{k}", PAGE.format(n=1)) for k in range(9)], "page_id bigint, url string, html string")
    assert {r.text for r in extract.extract(df).collect()} == {extract.main_text(PAGE.format(n=1))}


def slow_alignment(a, b):
    """The weight of the best common subsequence of two lists of groups, by trying everything."""
    if not a or not b:
        return 0.0
    best = max(slow_alignment(a[1:], b), slow_alignment(a, b[1:]))
    if a[0].label == b[0].label:
        p, q = {k.label for k in a[0].kids}, {k.label for k in b[0].kids}
        best = max(best, 1 + (len(p & q) / len(p | q) if p or q else 1.0) + slow_alignment(a[1:], b[1:]))
    return best


def test_alignment_is_the_best(monkeypatch):
    rng = random.Random(13)
    make = lambda: [extract.Node(rng.choice("abc"), [extract.Node(rng.choice("xyz")) for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(1, 6))]
    for _ in range(200):
        a, b = make(), make()
        if [x.label for x in a] == [x.label for x in b]:
            continue
        want, merged = slow_alignment(a, b), []
        with monkeypatch.context() as m:
            m.setattr(extract, "absorb", lambda x, y, same: merged.append((x, y)))
            m.setattr(extract, "alike", lambda x, y: False)
            root = extract.Node("r", list(a))
            extract.merge_kids(root, list(b), False)
        assert abs(sum(slow_alignment([x], [y]) for x, y in merged) - want) < 1e-9
        assert len(root.kids) == len(a) + len(b) - len(merged)  # the rest stays, in order
        assert [x for x in root.kids if any(x is y for y in a)] == a


def test_extract_query(spark):
    data = [(k, f"https://h{k % 2}.org/{k}", PAGE.format(n=k)) for k in range(8)] + [(None, None, None), (3, "https://h1.org/3", PAGE.format(n=3)), (9, "", ""), (10, "x", "<p>" + "a " * 50000)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").selectExpr("*", "'w' as wrapper", "1 as host", "2 as salt")
    got = Counter(rows(extract.extract(df)))
    assert got == Counter(rows(extract.extract(df, sent_bytes=0)))
    assert got == Counter((k, u, t := extract.main_text(h), len(t)) for k, u, h in data)
    assert rows(extract.extract(df.limit(0))) == []


# 2


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(1)
    texts = ["", " ", "  a  b\n\n c\t", "don't I'll", "<|endoftext|> x", "a<|endoftext|><|endoftext|>", "<|endoftext|", "語 ß \U0001f600", "a" * 3000] + ["".join(rng.choices("abc dé.,!?1\n'ß語", k=200)) for _ in range(50)]
    assert [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)] == [packing.encode(x) for x in texts]


def slow_fit(lengths, caps, rule):
    """Best fit a piece at a time over a list of sequences, each [free capacities, pieces]."""
    bins = []
    for length in sorted(lengths, reverse=True):
        need = (length, 1, length * length)
        best = None
        for k, (free, _) in enumerate(bins):
            if all(f >= n for f, n in zip(free, need)):
                parts = [(f / c * (n / c)) * -w if rule == "dot" else ((f - n) / c) ** 2 * w for f, n, c, w in zip(free, need, caps, packing.WEIGHTS)]
                score = sum(parts)
                if best is None or score < best[0] - 1e-15:
                    best = score, k
        if best is None:
            bins.append([list(caps), []])
            best = 0, len(bins) - 1
        b = bins[best[1]]
        b[0] = [f - n for f, n in zip(b[0], need)]
        b[1].append(length)
    return bins


def laid(histogram, limits, rule):
    """The sequences of a plan, each a list of (offset, length)."""
    bins, seen = defaultdict(list), Counter()
    for length, first, n, each, at, offset in packing.plan(histogram, *limits, rule=rule):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            bins[at + k // each].append((offset + k % each * length, length))
    assert seen == histogram
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(1024, 1024, 1 << 20), (100, 3, 4000), (64, 64, 1 << 12), (60, 5, 1500), (30, 4, 300)])
def test_plan_is_best_fit_of_single_pieces(rule, limits):
    rng = random.Random(2)
    top = min(limits[0], int(limits[2] ** 0.5))
    for kind in range(12):
        lengths = [min(top, 1 + int(rng.random() ** rng.choice([1, 2, 4]) * top)) for _ in range(rng.randint(1, 250))]
        if kind % 3 == 0:
            lengths = [rng.choice(lengths[:5]) for _ in lengths]
        bins = laid(Counter(lengths), limits, rule)
        for b in bins.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            own = [n for _, n in b]
            assert at <= limits[0] and len(own) <= limits[1] and sum(x * x for x in own) <= limits[2]
        want = Counter(tuple(sorted(x)) for _, x in slow_fit(lengths, limits, rule))
        assert Counter(tuple(sorted(n for _, n in b)) for b in bins.values()) == want
        assert sorted(bins) == list(range(len(bins)))


def test_plan_is_near_the_least_number():
    rng = random.Random(3)
    histogram = Counter(rng.randint(1, 1024) for _ in range(30_000))
    n = len(laid(histogram, (1024, 1024, 1 << 20), "norm"))
    assert n <= 1.01 * sum(k * v for k, v in histogram.items()) / 1024 + 1


@pytest.mark.parametrize("limits", [(256, 256, 1 << 16), (256, 2, 1 << 16), (256, 256, 70_000)])
def test_pack(awkward, limits):
    from tests.llm.conftest import AWKWARD

    import numpy as np

    got = packing.pack(awkward, *limits).collect()
    enc, want = tokenizer(), Counter()
    for doc_id, text, *_ in AWKWARD:
        ids = np.array([*enc.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 256)))
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= limits[0] and len(b) <= limits[1] and sum(n * n for _, n in b) <= limits[2]
    fit = slow_fit([r.length for r in got], limits, "norm")
    assert Counter(tuple(sorted(n for _, n in b)) for b in bins.values()) == Counter(tuple(sorted(x)) for _, x in fit)
    assert rows(packing.pack(awkward.limit(0))) == []


# 3


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, d[j + 1] = d[j + 1], before + 1 if x == y else max(d[j], d[j + 1])
    return d[-1]


def slow_hash(raw):
    """The fingerprint byte by byte."""
    n = len(raw)
    if not n:
        return "3:::"

    def roll(i):
        x = sum(w * 0x01000193 * pow(0x85EBCA6B, k, 1 << 32) for k, w in enumerate([raw[i - k] if i >= k else 0 for k in range(7)])) % (1 << 32)
        x ^= x >> 15
        x = x * 0x2C1B3C6D % (1 << 32)
        return x ^ x >> 12

    r = [roll(i) for i in range(n)]
    at = lambda b: [i for i in range(n) if r[i] % b == b - 1]
    block = 3
    while block * 64 < n:
        block *= 2
    while len(at(block)) < 24 and block > 3:
        block //= 2

    def signs(b):
        ends = at(b)[:255]
        ends += [n - 1] * (not ends or ends[-1] != n - 1)
        out, start = "", 0
        for e in ends:
            h = sum((raw[i] + 1) * pow(fuzzy._ODD, i - start, 1 << 64) for i in range(start, e + 1)) % (1 << 64)
            h ^= h >> 29
            h = h * 0xBF58476D1CE4E5B9 % (1 << 64)
            out += fuzzy.ALPHABET[h >> 58]
            start = e + 1
        return re.sub(r"(.)\1{3,}", r"\1\1\1", out)

    return f"{block}:{signs(block)}:{signs(2 * block)}:{signs(4 * block)}"


def test_fuzzy_hash():
    rng = random.Random(3)
    for n in (0, 1, 6, 7, 8, 63, 200, 1000, 3000):
        raw = bytes(rng.choices(range(97, 107), k=n))
        assert fuzzy.fuzzy_hash(raw) == slow_hash(raw)
    assert fuzzy.fuzzy_hash(b"ab" * 2000) == slow_hash(b"ab" * 2000)
    for _ in range(100):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 70))) for _ in range(2))
        assert fuzzy.common_length(a, b) == lcs(a, b)


def test_likeness_tells_edits_from_others():
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400))
    for _ in range(10):
        a, b = text(), text()
        f, g, h = (fuzzy.fuzzy_hash(x.encode()) for x in (a, fuzzy.edited(a, b), b))
        assert fuzzy.likeness(f, f) == 1 and fuzzy.likeness(f, g) > 0.5 and fuzzy.likeness(f, h) == 0
    assert fuzzy.likeness(None, f) is None


def test_neighbours(spark, awkward, monkeypatch):
    monkeypatch.setattr(fuzzy, "RANGE_DOCS", 7)
    data = [(k, "".join(random.Random(k).choices("abcdef ", k=k % 37 * 3))) for k in range(60)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    want = []
    for k, t in data:
        nxt = dict(data)[(k - 1) % 60]
        e = fuzzy.edited(t, nxt)
        f = fuzzy.fuzzy_hash(t.encode())
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), f, fuzzy.fuzzy_hash(e.encode()), fuzzy.likeness(f, fuzzy.fuzzy_hash(e.encode())), fuzzy.likeness(f, fuzzy.fuzzy_hash(nxt.encode()))))
    assert sorted(rows(fuzzy.fingerprint_neighbours(df.repartition(5)))) == want
    got = rows(fuzzy.fingerprint_neighbours(awkward))
    assert len(got) == 10 and rows(fuzzy.fingerprint_neighbours(awkward.limit(0))) == []
    assert rows(fuzzy.fingerprint_neighbours(spark.createDataFrame([(1, "one")], "doc_id bigint, text string")))[0][6] == 1.0


# 4


def test_language(spark, awkward):
    rng = random.Random(5)
    syllables = {"en": "th ing er on re at".split(), "de": "sch ung ein ich ge zu".split(), "es": "ción ado os la que ia".split()}
    make = lambda k: " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 4))) for _ in range(12))
    data = [(k, make(lang), lang) for k, lang in enumerate(rng.choices(sorted(syllables), k=400))]
    got = rows(language.identify(spark.createDataFrame(data, "doc_id bigint, text string, lang string")))
    truth = {k: lang for k, _, lang in data}
    held = [(k, p) for k, out, p, _ in got if out]
    assert {k for k, _ in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(truth[k] == p for k, p in held) >= 0.98 * len(held) and all(0 <= s <= 1 for *_, s in got)
    got = Counter((k, p) for k, _, p, _ in rows(language.identify(awkward)))
    assert got[2, "und"] == got[3, "und"] == got[4, "und"] == 1 and sum(got.values()) == 10
    assert rows(language.identify(awkward.limit(0))) == []


def test_language_uses_all_counts(spark, monkeypatch):
    rng = random.Random(6)
    make = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 7)))
    data = [(k, " ".join(make("abcdefg" if k % 5 else "cdefghi") for _ in range(rng.randint(0, 15))), "hot" if k % 5 else "small") for k in range(200)]
    data += [(500, "zzzz \u00df", None), (501, data[0][1], None), (None, None, "hot"), (502, "12", "hot")]
    d = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    predict = language.train(d).predictor()
    want = Counter((k, predict(t)[0]) for k, t, _ in data)
    scores = {k: predict(t)[1] for k, t, _ in data}
    for bound in (10**6, 20, 0):  # all words sent, some, none
        monkeypatch.setattr(language, "MODEL_WORDS", bound)
        got = rows(language.identify(d))
        assert Counter((k, p) for k, _, p, _ in got) == want
        assert all(abs(s - scores[k]) < 1e-4 for k, _, _, s in got)


def test_language_model_by_hand():
    class R:
        def __init__(self, lang, item, n):
            self.lang, self.item, self.n = lang, item, n

    m = language.Model([R("a", "xx", 10), R("b", "xx", 1)], [R("a", "xy", 5), R("b", "z", 5)], {"a": 100, "b": 100}, {("a", 2): 50, ("b", 1): 50})
    predict = m.predictor()
    assert predict("xx")[0] == predict("XX xx")[0] == "a" and predict("xx")[1] < predict("XX xx")[1]
    assert m.unseen("xy").tolist() == [1.0, 7.0] and m.unseen("z").tolist() == [7.0, 1.0] and predict("zz")[0] == "b"
    assert predict("½ 12") == predict(None) == ("und", 0.0)


# 5


def test_sharding(spark, awkward):
    d = spark.createDataFrame([(k, f"t{k}") for k in range(4000)], "doc_id bigint, text string")
    got = sharding.shard_documents(d).collect()
    each = Counter(r.shard for r in got)
    assert set(each) == set(range(40)) and max(each.values()) < 1.45 * 100 and min(each.values()) > 0.6 * 100
    assert all(r.grown_shard in (r.shard, 40) for r in got) and 50 < sum(r.grown_shard == 40 for r in got) < 150
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.doc_id, r.slot))
    assert all([s for _, s in sorted(b)] == list(range(len(b))) for b in by.values())
    got = sharding.shard_documents(awkward).collect()
    from tests.llm.conftest import AWKWARD

    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in AWKWARD)
    assert rows(sharding.shard_documents(awkward.limit(0))) == []


def slow_descent(key, shards, weights):
    """The shard of one key from the levels of the tree."""
    import math

    digest = hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()
    parts = [int(digest[8 * i : 8 * i + 8], 16) % sharding.PRIME for i in range(4)]

    def draw(node, weight):
        c = sharding.constant(node)
        x = (((parts[0] * c + parts[1]) * c + parts[2]) * c + parts[3]) % sharding.PRIME
        return -math.log((x + 0.5) / sharding.PRIME) / weight

    weight = lambda s: weights.get(s, 1.0)
    racks = defaultdict(list)
    for s in range(shards):
        racks[s // 4 if s < 40 else 40 + s].append(s)
    regions = defaultdict(list)
    for r in racks:
        regions[r // 5 if r < 40 else r].append(r)
    of_rack = lambda r: sum(weight(s) for s in racks[r])
    region = min(regions, key=lambda g: draw((1 << 26) + g, sum(map(of_rack, regions[g]))) if len(regions) > 1 else 0)
    rack = min(regions[region], key=lambda r: draw((1 << 27) + r, of_rack(r)))
    return min(racks[rack], key=lambda s: draw(s, weight(s)))


def test_descent_level_by_level(spark):
    d = spark.createDataFrame([(k,) for k in [*range(600), None]], "doc_id bigint")
    for shards, weights in ((40, {}), (41, {}), (23, {3: 2.5, 20: 0.5}), (43, {41: 4.0})):
        got = sharding.place(d, "doc_id", shards, "s", weights).collect()
        assert all(r.s == slow_descent(r.doc_id, shards, weights) for r in got)


def test_weights_move_rows_inside_the_tree():
    import numpy as np

    parts = [np.random.default_rng(6).integers(0, sharding.PRIME, 60000) for _ in range(4)]
    before = sharding.descend(parts, sharding.tree(40))
    after = sharding.descend(parts, sharding.tree(40, {7: 3.0}))
    assert 2.6 < (after == 7).sum() / (before == 7).sum() < 3.4
    region, rack = lambda s: s // 20, lambda s: s // 4
    moved = before != after
    # a row moves into the region or within it, and in it into the rack or within that
    assert (region(after[moved]) == 0).all()
    inside = moved & (region(before) == 0)
    assert (rack(after[inside]) == 1).all() and (after[inside & (rack(before) == 1)] == 7).all()
    assert moved.mean() < 0.12
    none = sharding.descend(parts, sharding.tree(40, {7: 0.0}))
    assert not (none == 7).any() and (region(before[before != none]) == 0).all()
    for n in range(40, 45):  # one more takes rows into itself alone
        a, b = (sharding.descend(parts, sharding.tree(k)) for k in (n, n + 1))
        assert (b[a != b] == n).all() and 0.7 < (b == n).sum() * (n + 1) / 60000 < 1.3


def test_sharding_by_more_parts(spark, monkeypatch):
    from folioscan.llm import common

    d = spark.createDataFrame([(k % 500, f"t{k}") for k in range(1000)] + [(None, "x")], "doc_id bigint, text string")
    want = sorted(rows(sharding.shard_documents(d)), key=repr)
    monkeypatch.setattr(common.range_bounds, "__defaults__", (50,))
    assert sorted(rows(sharding.shard_documents(d)), key=repr) == want


def test_many_rows_without_a_number(spark):
    d = spark.createDataFrame([(None if k % 3 else k, f"t{k % 700}") for k in range(3000)], "doc_id bigint, text string")
    got = sharding.shard_documents(d).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"], r.slot))
    for b in by.values():
        b.sort(key=lambda x: x[4])
        assert [x[4] for x in b] == list(range(len(b))) and [x[:4] for x in b] == sorted(x[:4] for x in b)
    packed = packing.pack(d).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == 3000 == len(packed)


# 6


def test_mixing(spark, awkward):
    import math

    data = [(k, f"s{min(k % 7, 3)}", "x" * (k % 50)) for k in range(3000)]
    d = spark.createDataFrame(data, "doc_id bigint, source string, text string")
    rate = {r.source: r.rate for r in mixing.rates(d).collect()}
    got = mixing.mix(d).collect()
    copies = Counter(r.doc_id for r in got)
    for k, s, _ in data:
        u = (int(hashlib.md5(f"mix:{k}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, below = 0, math.exp(-rate[s]), math.exp(-rate[s])
        while below <= u:
            n += 1
            p *= rate[s] / n
            below += p
        assert copies[k] == n
    key = lambda r: (int(hashlib.md5(f"mix:{r.doc_id}:copy:{r.copy}".encode()).hexdigest()[:13], 16), r.doc_id, r.copy)
    assert [r.position for r in sorted(got, key=key)] == list(range(len(got)))
    weights = {"s0": 1.0, "s3": 3.0}
    out = Counter()
    for r in mixing.mix(d, weights, epochs=2.0).collect():
        out[r.source] += len(r.text) + 1
    assert set(out) == {"s0", "s3"} and 2.6 < out["s3"] / out["s0"] < 3.4
    assert Counter(mixing.shuffled(d).select("doc_id").toPandas()["doc_id"]) == copies
    got = Counter(r.doc_id for r in mixing.mix(awkward).collect())
    from tests.llm.conftest import AWKWARD

    size = Counter()
    for _, t, _, s in AWKWARD:
        size[s] += len(t or "") + 1
    want = Counter()
    for k, _, _, s in AWKWARD:
        mean = sum(size.values()) * size[s] ** 0.5 / sum(n**0.5 for n in size.values()) / size[s]
        u = (int(hashlib.md5(f"mix:{'null' if k is None else k}:1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n = 0
        while sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(n + 1)) <= u:
            n += 1
        want[k] += n
    assert got == +want and mixing.mix(awkward.limit(0)).count() == 0
    assert Counter(r.doc_id for r in mixing.shuffled(awkward).collect()) == got
    one = mixing.mix(spark.createDataFrame([(1, "s", "x")] * 2 + [(2, None, None)], "doc_id bigint, source string, text string"), {"s": 1.0}, epochs=400.0).collect()
    assert len({r.doc_id for r in one}) == 1 and 500 < len(one) < 1500  # means over LARGEST_MEAN


def test_mixing_of_hot_and_rare_sources(spark, monkeypatch):
    data = [(k, f"s{k if k % 3 else 0}", "x" * (k % 50)) for k in range(600)] + [(700, None, "y")]
    d = spark.createDataFrame(data, "doc_id bigint, source string, text string")
    want = Counter(rows(mixing.repetitions(d)))
    for hot in (1, 5, 10**6):  # one source is sent, or all are
        monkeypatch.setattr(mixing, "HOT_KEYS", hot)
        assert Counter(rows(mixing.repetitions(d))) == want


# 7


def slow_kn(train, n):
    """Probabilities of modified Kneser-Ney by recursion over dictionaries."""
    c = {n: Counter()}
    for t in train:
        s = quality.BEGIN * (n - 1) + t + quality.END
        c[n].update(s[i : i + n] for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {k: quality.discounts(Counter(v for v in c[k].values())) for k in c}

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(c[1]) + 1)
        own = {x: v for x, v in c[k].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        cut = lambda v: d[k][min(v, 3) - 1]
        return (max(0, own[g] - cut(own[g])) if g in own else 0) / total + sum(cut(v) for v in own.values()) / total * p(g[1:])

    return p


def test_kneser_ney(spark):
    import math

    rng = random.Random(7)
    train = ["".join(rng.choices("abcd ", weights=[5, 3, 2, 1, 2], k=60)).strip() for _ in range(20)]
    train = [quality.normal(t) for t in train]
    other = ["zzz q", "", "abab cd", "a"]
    p = slow_kn(train, 3)
    counts = quality.Counts(quality.count_grams(spark.createDataFrame([(t,) for t in train], "text string"), 3), 3)
    docs = spark.createDataFrame([(k, None, t) for k, t in enumerate(train[:5] + other)], "doc_id bigint, lang string, text string")
    for rows_sent in (10**6, 0):
        got = {r.doc_id: r.log_perplexity for r in quality.score(docs, counts, rows_sent).collect()}
        for k, t in enumerate(train[:5] + other):
            s = quality.BEGIN * 2 + t + quality.END
            want = -sum(math.log(p(s[i : i + 3])) for i in range(len(s) - 2)) / (len(t) + 1)
            assert got[k] is None if not t else abs(got[k] - want) < 1e-9
    everything = sorted(set("".join(train))) + [quality.END]
    assert abs(sum(p("ab" + x) for x in everything) + p("ab\x01") - 1) < 1e-9


def test_quality_counts_all_trusted_documents(spark):
    import math

    from pyspark.sql import functions as F

    n = 60_000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.expr("char(97 + id % 7)"), F.expr("char(97 + id % 5)")).alias("text"))
    fold = {r[0]: r[1] for r in d.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(quality.FOLDS))).collect()}
    p = slow_kn([chr(97 + k % 7) + chr(97 + k % 5) for k in range(n) if fold[k]], quality.ORDER)
    labels = d.selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = {r.text_hash: r.perplexity for r in quality.judge(d, labels).select("text_hash", "perplexity").distinct().collect()}
    hashes = {r[0]: r[1] for r in d.limit(35).select("text", F.xxhash64("text")).collect()}
    assert len(hashes) == len(got) == 35
    for t, h in hashes.items():
        s = quality.BEGIN * (quality.ORDER - 1) + t + quality.END
        want = -sum(math.log(p(s[i : i + quality.ORDER])) for i in range(len(t) + 1)) / (len(t) + 1)
        assert abs(math.log(got[h]) - want) < 1e-9


def test_probabilities_are_sent_in_slices(spark, monkeypatch):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, "en", "".join(rng.choices("abcdefgh ", k=200)).strip()) for k in range(60)], "doc_id bigint, lang string, text string")
    counts = quality.Counts(quality.count_grams(docs.limit(30).select("text"), 3), 3)
    want = {r.doc_id: r.log_perplexity for r in quality.score(docs, counts, 0).collect()}  # by buckets
    context, sizes = type(spark.sparkContext), []
    send = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: (sizes.append(len(value[0])), send(self, value))[1])
    for held in (10**6, 64):
        monkeypatch.setattr(quality, "HELD_ROWS", held, raising=False)
        sizes.clear()
        got = {r.doc_id: r.log_perplexity for r in quality.score(docs, counts, 10**6).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert 500 < sum(sizes) and (len(sizes) == 1 if held == 10**6 else max(sizes) <= 4 * held + 20)


def test_growing_tables_are_not_sent(spark, tmp_path):
    """Spark judges written tables by their compressed files; those that grow with the input are joined by shuffle."""
    texts = spark.createDataFrame([(f"one two three {k} four",) for k in range(50)], "text string")
    counts = quality.Counts(quality.count_grams(texts, 3), 3)
    plans = [counts.probabilities(quality.distinct_grams(texts, 3))._jdf.queryExecution().toString()]
    docs = spark.createDataFrame([(k, f"some words {k}", "en", "a", 9) for k in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    chosen = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    plans += [x._jdf.queryExecution().toString() for x in (corpus_pipeline.keep(docs, chosen), corpus_pipeline.identify_language(spark, docs, str(tmp_path)), language.identify(docs))]
    for plan in plans:
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_quality_keeps_clean_texts(spark, awkward):
    rng = random.Random(8)
    clean = lambda: " ".join("".join(rng.choices("th ing er on re at".split(), k=rng.randint(1, 4))) for _ in range(60))
    junk = lambda: " ".join("".join(rng.choices("XQZ#$%&!", k=6)) for _ in range(60))
    data = [(k, "en", junk() if k % 10 == 0 else clean()) for k in range(300)]
    d = spark.createDataFrame(data, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(k, int(k % 10 != 0), 0) for k in range(200)] + [(None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.keep for r in quality.judge(d, labels).collect()}
    assert all(kept[k] == (k % 10 != 0) for k in range(300))
    got = quality.judge(awkward, labels.limit(0)).collect()
    assert len(got) == 10 and all(r.keep == bool((r.perplexity or 0) > 0) for r in got)
    assert rows(quality.judge(awkward.limit(0), labels)) == []


# 8


@pytest.mark.parametrize("n", [0, 1, 100, 162, 163, 164, 575, 576, 577, 9215, 9216, 9217, 100_000])
def test_transport_stream(n):
    payload = random.Random(n).randbytes(n)
    ts = media.write_ts(payload)
    assert len(ts) % 188 == 0 and all(ts[i] == 0x47 for i in range(0, len(ts), 188))
    r = media.read_ts(ts)
    units = -(-n // media.UNIT_BYTES)
    assert r["payload"] == payload and r["counter_errors"] == 0 and r["pts"] == [k * media.TICKS for k in range(units)]
    assert r["random_access"] == [k * media.UNIT_BYTES for k in range(0, units, media.GROUP)]


def test_lost_packets_and_damage_are_seen():
    ts = media.write_ts(bytes(5000))
    assert media.read_ts(ts[: 188 * 5] + ts[188 * 6 :])["counter_errors"] == 1
    for bad in (ts[1:], b"\0" + ts[1:], ts[:30] + b"\0" + ts[:10] + ts[41:], b"", ts[:188], ts[188:], ts[:12] + b"\1" + ts[13:]):
        with pytest.raises(ValueError):
            media.read_ts(bad)
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_repeated_packets_and_stated_discontinuities_are_no_errors():
    payload = random.Random(0).randbytes(5000)
    ts = media.write_ts(payload)
    packets = [ts[k : k + 188] for k in range(0, len(ts), 188)]
    for k in (2, 4):  # the first has a clock reference, which the repetition may renew
        again = bytearray(packets[k])
        if k == 2:
            again[8] ^= 1
        r = media.read_ts(b"".join(packets[: k + 1]) + bytes(again) + b"".join(packets[k + 1 :]))
        assert r["payload"] == payload and r["counter_errors"] == 0
        r = media.read_ts(b"".join(packets[: k + 1]) + bytes(again) + packets[k] + b"".join(packets[k + 1 :]))
        assert r["counter_errors"] == 1
    only_field = bytes([0x47, 0x01, 0, 0x20, 183, 0]) + b"\xff" * 182  # no payload: the counter stays
    assert media.read_ts(b"".join(packets[:4]) + only_field + b"".join(packets[4:]))["payload"] == payload
    jump = [bytes([*p[:3], p[3] & 0xF0 | (p[3] + 5) & 15, *p[4:]]) for p in packets[3:]]
    assert media.read_ts(b"".join(packets[:3] + jump))["counter_errors"] == 1
    units = media.write_ts(bytes(20000))
    cut = next(k for k in range(188 * 3, len(units), 188) if units[k + 1] & 0x40)
    stated = bytearray(units[cut:])
    stated[5] |= 0x80
    for k in range(0, len(stated), 188):
        stated[k + 3] = stated[k + 3] & 0xF0 | (stated[k + 3] + 5) & 15
    assert media.read_ts(units[:cut] + bytes(stated))["counter_errors"] == 0


def slow_ts(ts):
    """The first stream of a transport stream by the book, a byte at a time."""
    out, pts, points, unit = b"", [], [], None
    for k in range(376, len(ts), 188):
        p = ts[k : k + 188]
        at = 5 + p[4] if p[3] & 0x20 else 4
        body = p[at:]
        if p[1] & 0x40:
            assert body[:4] == b"\0\0\1\xbd"
            t = body[9:14]
            pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
            if p[3] & 0x20 and p[5] & 0x40:
                points.append(len(out))
            body = body[9 + body[8] :]
        out += body
    return out, pts, points


def test_media(spark, awkward, tmp_path):
    from tests.llm.conftest import AWKWARD

    got = media.parse_media(media.add_media(awkward)).collect()
    want = Counter((k, len(raw := (t or "").encode()), hashlib.sha256(raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)).hexdigest()) for k, t, *_ in AWKWARD)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == want
    assert media.add_media(awkward.limit(0)).count() == 0
    none = media.parse_media(spark.createDataFrame([(1, 2, None)], "doc_id bigint, n_bytes bigint, media binary")).first()
    assert none.pts == [] and none.payload_sha256 is None
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter()
    for r in media.op8_media(spark, str(tmp_path)).collect():
        got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, tuple(r.pts), tuple(r.random_access)] += 1
    want = Counter()
    for k, t, *_ in AWKWARD:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) % 576 if not raw or len(raw) % 576 else 0)
        ts = media.write_ts(payload)
        out, pts, points = slow_ts(ts)
        assert out == payload
        feature = f"ts;program=1;pid=256;type=6;packets={len(ts) // 188 - 2};units={len(pts)};first_pts={pts[0]};last_pts={pts[-1]};random_access={','.join(map(str, points))};errors=0"
        want[k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(ts), hashlib.sha256(ts).hexdigest(), feature, tuple(pts), tuple(points)] += 1
    assert got == want


# 9


def test_simhash_classes(spark, awkward):
    import numpy as np

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 10))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(150)]
    for k in range(150):
        w = texts[k % 30].split()
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    prints = np.frombuffer(b"".join(map(simhash.simhash, texts)), np.uint64).reshape(-1, 4)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= simhash.DISTANCE
    root = list(range(300))
    for _ in range(300):
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(300)]
        if new == root:
            break
        root = new
    same = (prints[:, None] == prints[None]).all(axis=2)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    links = [len({prints[j].tobytes() for j in np.flatnonzero(near[i] & ~same[i])}) for i in range(300)]
    for bucket_rows in (4096, 4):  # whole buckets, and buckets that are cut
        got = {r.doc_id: r for r in simhash.near_duplicates(d, bucket_rows=bucket_rows).collect()}
        assert [got[k].class_id for k in range(300)] == root
        assert [got[k].links for k in range(300)] == links
        assert [got[k].copies for k in range(300)] == same.sum(axis=1).tolist()
        assert [k for k in range(300) if got[k].first] == sorted(set(root))
    got = simhash.near_duplicates(awkward).collect()
    of = {(r.doc_id, r.text_hash): r for r in got}
    assert len(got) == 10 and {r.class_id for r in got if r.doc_id == 1} == {1} and sum(r.copies == 2 for r in got) == 6
    assert sum(bool(r.first) for r in of.values()) == len({r.class_id for r in got})
    assert rows(simhash.near_duplicates(awkward.limit(0))) == []


def test_simhash_recall_at_any_size(spark, monkeypatch):
    import numpy as np

    size = simhash.sample_size
    at_least = simhash.recall(simhash.LEAST_SAMPLE, simhash.TABLES)
    for n in (10**3, 10**5, 11 * 10**6, 10**9):
        assert simhash.recall(size(n), simhash.table_count(size(n))) >= at_least - 1e-9
    rng = np.random.default_rng(3)
    prints = []
    for _ in range(300):  # lone pairs at the greatest distance
        a = rng.integers(0, 2, simhash.BITS, np.uint8)
        b = a.copy()
        b[rng.permutation(simhash.BITS)[: simhash.DISTANCE]] ^= 1
        prints += [np.packbits(a).tobytes(), np.packbits(b).tobytes()]
    d = spark.createDataFrame(list(enumerate(map(bytearray, prints))), "id bigint, fp binary")
    for n, bucket_rows in ((600, 4096), (11 * 10**6, 4096), (11 * 10**6, 1)):
        monkeypatch.setattr(simhash, "sample_size", lambda _, n=n: size(n))
        got = simhash.near_links(d, bucket_rows=bucket_rows).where("id <> other").groupBy("id").count().collect()
        assert len({r.id // 2 for r in got}) >= 0.94 * 300


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 499), (499, 499)], "id bigint, other bigint")
    got = dict(rows(simhash.components(links).select("id", "root")))
    assert got == {k: 0 for k in range(201)} | {499: 499, 500: 499}


# 10


def test_warc(spark):
    big = "x" * 200
    data = [(k, f"http://a/{k}\r\nEvil: 1", f"<p>{k % 5}" + big if k % 3 else "short") for k in range(300)]
    data += [(None, None, None), (400, "u", None), (401, "u", ""), (1, "http://again", "<p>1" + big), (None, "n", "<p>1" + big), (402, "l", random.Random(1).randbytes(200_000).hex())]
    p = spark.createDataFrame(data, "page_id bigint, url string, html string").selectExpr("*", "1 as payload", "2 as key", "3 as first")
    folder = new_folder(spark, "warc")
    written = warc.write_warc(p.repartition(3), folder).collect()
    first = {}
    for k, _, h in data:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = Counter()
    for k, _, h in data:
        raw = (h or "").encode()
        again = len(raw) >= 100 and h in first and (k is None or k > first[h])
        want[k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    for split in (32 << 20, 5000, 64):
        got = warc.read_warc(spark, folder, split)
        assert Counter(rows(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))) == want
    assert sum(r.records for r in written) == len(data)
    assert warc.read_warc(spark, new_folder(spark, "none")).count() == 0
    assert warc.write_warc(p.limit(0), new_folder(spark, "warc")).count() == 0


def test_warc_range_owns_what_starts_in_it(tmp_path):
    import io

    members = [warc.encode_record(k, "u", random.Random(k).randbytes(50 * k), hashlib.sha256(random.Random(k).randbytes(50 * k)).hexdigest(), None, False) for k in range(20)]
    data = b"junk" + b"".join(members[:10]) + warc.MAGIC + b"no member" + b"".join(members[10:])
    for split in (1, 7, 100, 1000, len(data)):
        got = [r["page_id"] for s in range(0, len(data), split) for _, r in warc.read_range(io.BytesIO(data), s, min(len(data), s + split))]
        assert got == list(range(20))


def test_warc_damage_is_counted(spark, tmp_path):
    members = [warc.encode_record(k, "u", random.Random(k).randbytes(50 * k), hashlib.sha256(random.Random(k).randbytes(50 * k)).hexdigest(), None, False) for k in range(20)]
    bad = members[12][:40] + b"zz" + members[12][42:]
    (tmp_path / "a.warc.gz").write_bytes(b"junk" + b"".join(members[:5]) + b"noise" + b"".join(members[5:12]) + bad + b"".join(members[13:]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    for split in (1 << 20, 1000, 100):
        damaged = spark.sparkContext.accumulator(0)
        got = [r.page_id for r in warc.read_warc(spark, f"file://{tmp_path}", split, damaged).collect()]
        assert sorted(got) == sorted([*range(20), *(k for k in range(20) if k != 12)]) and damaged.value == 3
