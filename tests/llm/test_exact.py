"""Operators against brute force on a small corpus, with odd rows."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from hexweave.llm import near_dedup as near
from hexweave.llm import packing, pieces, private_data, suffixes
from hexweave.llm.common import with_trust
from hexweave.llm.line_dedup import line_dedup
from hexweave.llm.quality_rules import quality_rules
from hexweave.llm.queries import tokenizer
from hexweave.llm.url_filters import url_filters

WORD = r"[^\x20\x09-\x0D]+"


def same(got, want):
    assert Counter(got) == Counter(want)


# --- 1 ---


def base_rules(text):
    w = re.findall(WORD, text or "")
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed
    )


def test_quality_rules(docs, rows, labels, nothing):
    out = quality_rules(docs, labels).collect()
    same([tuple(r[:6]) + (r["base_failed"],) for r in out], [(r[0], *base_rules(r[1])) for r in rows])
    for r in out:
        assert r["kept"] == (not r["base_failed"] and r["llr"] is not None and round(r["llr"], 9) >= -0.06)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[130]["llr"] is None and not by_id[131]["kept"]
    assert by_id[128]["llr"] < by_id[10]["llr"]
    assert quality_rules(nothing, labels).collect() == []
    unlabelled = quality_rules(docs, labels.where("false")).collect()
    assert {r["kept"] for r in unlabelled if not r["base_failed"]} == {True}


# --- 2 ---


@pytest.mark.parametrize(("spare", "at_least"), [(False, 2), (True, 2), (False, 5)])
def test_line_dedup(docs, rows, nothing, spare, at_least):
    bare = [(900 + i, "Home | About\n\nAll rights", "en", "a", 24) for i in range(3)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(bare, "doc_id long, text string, lang string, source string, n_chars long"), True)
    rows = [*rows, *bare]
    pages, total = Counter(), Counter()
    for r in rows:
        total[r[3] or ""] += 1
        pages.update({(r[3] or "", x) for x in (r[1] or "").split("\n") if re.search(WORD, x)})
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        host = r[3] or ""
        worded = [x for x in lines if re.search(WORD, x)]
        gone = {x for x in worded if pages[host, x] >= at_least and pages[host, x] > 0.05 * total[host]}
        kept = [x for x in lines if x not in gone]
        left = [x for x in kept if re.search(WORD, x)]
        same_text = len(left) == len(worded) or (spare and not left)
        want.append((r[0], len(worded), 0 if same_text else len(worded) - len(left), r[1] if same_text else "\n".join(kept)))
    out = line_dedup(docs, min_pages=at_least, spare=spare)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    same([tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()], want)
    assert sum(w[2] for w in want) > 50
    assert [w[3] for w in want if w[0] == 901] == ["Home | About\n\nAll rights" if spare else ""]
    assert line_dedup(nothing).collect() == []


def test_line_dedup_of_a_long_page(spark):
    """Distinct lines and hits are found by hash: 200,000 lines take seconds."""
    long = "\n".join(f"line {i}" for i in range(200_000))
    data = [(i, t, "h") for i, t in enumerate([long, "top\nline 7\nend", "line 7\nown", "top"])]
    start = time.monotonic()
    out = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert time.monotonic() - start < 60
    assert out[0]["n_lines"] == 200_000 and out[0]["n_dropped"] == 1 and "line 7\n" not in out[0]["text"]
    assert [out[i]["text"] for i in (1, 2, 3)] == ["end", "own", ""]


# --- 3 ---


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want.append((r[0], k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    out = packing.pack(docs, path).collect()
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out], want)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)
    fill = defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack(nothing, path).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5 + seed / 2, 1, 3000).astype(int), 1, 2048)
    histogram = Counter(lengths.tolist())
    used = Counter()
    groups = packing.plan(dict(histogram))
    for pattern, n in groups:
        assert sum(pattern) <= 2048
        for length in pattern:
            used[length] += n
    assert used == histogram
    assert sum(n for _, n in groups) <= 1.01 * lengths.sum() / 2048 + 1


def test_plan_without_filling_patterns():
    assert sum(n for _, n in packing.plan({1500: 7})) == 7
    assert sum(n for _, n in packing.plan({700: 7})) == 4
    assert packing.plan({}) == []


# --- 4 ---


def shingles(text, width):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)])


def near_groups(rows, width):
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    label = {i: i for i, _ in sets if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    live = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(live):
        for j, t in live[:k]:
            if 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [
        (i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets
    ]


@pytest.mark.parametrize(("width", "block", "shingles"), [(2, 2000, 10**6), (2, 3, 10**6), (2, 2000, 150), (5, 2000, 10**6)])
def test_near_dedup(docs, rows, nothing, monkeypatch, width, block, shingles):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", shingles)
    want = near_groups(rows, width)
    same([tuple(r) for r in near.near_dedup(docs, width=width).collect()], want)
    assert sum(not w[3] for w in want) > 5
    assert near.near_dedup(nothing, width=width).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    sets = []
    for shared in (0, 20, 50, 90, 100):
        own = rng.integers(0, 2**63, (2, 100 - shared), dtype=np.uint64)
        both = rng.integers(0, 2**63, shared, dtype=np.uint64)
        sets += [np.concatenate([both, own[0]]), np.concatenate([both, own[1]])]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = near.sketch(np.concatenate(sets), offsets)
    assert (out != near.MAX).all()
    for k, shared in enumerate((0, 20, 50, 90, 100)):
        assert abs((out[2 * k] == out[2 * k + 1]).mean() - shared / (200 - shared)) < 0.13
    lone = near.sketch(np.array([5], np.uint64), np.array([0, 1]))
    assert (lone != near.MAX).all()


# --- 5 ---


def removed(rows):
    first = {}
    last = suffixes.LAST
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], last), last if r[0] is None else r[0])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (last if r[0] is None else r[0]):
                mark[i : i + 50] = b"\1" * 50
        rest = bytes(x for x, y in zip(b, mark, strict=True) if not y)
        runs = sum(1 for i, y in enumerate(mark) if y and (not i or not mark[i - 1]))
        out.append((r[0], len(b), sum(mark), runs, hashlib.sha256(rest).hexdigest(), rest))
    return out


@pytest.mark.parametrize("part, hot", [(3000, 400), (3000, 1 << 20), (4 << 20, 400)])
def test_suffix_dedup(docs, rows, nothing, monkeypatch, part, hot):
    for name in ("PART_BYTES", "SORT_SHARD_BYTES", "ANCHOR_SHARD_BYTES"):
        monkeypatch.setattr(suffixes, name, part)
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot)
    got = [(*r[:5], bytes(r[5])) for r in suffixes.suffix_dedup(docs).collect()]
    same(got, removed(rows))
    assert suffixes.suffix_dedup(nothing).collect() == []


@pytest.mark.parametrize("phrase", [20, 40, 60])
def test_a_frequent_phrase_is_spread(spark, monkeypatch, phrase):
    """A phrase in every document between different words, NULL ids among them; no shard holds all of it."""
    rng = np.random.default_rng(phrase)
    letters = np.array([*"abcdefghijklmnopqrstuvwxyz    "])
    common = "".join(rng.choice(letters, phrase))
    rows = []
    for i in range(1200):
        a, b = ("".join(rng.choice(letters, rng.integers(60, 120))) for _ in range(2))
        rows.append((None if i % 3 == 0 else i, f"{a}{common}{b}"))
    rows += [(2000 + i, rows[i][1][20:150]) for i in range(0, 60)]
    size = sum(len(r[1]) for r in rows)
    monkeypatch.setattr(suffixes, "PART_BYTES", size // 40)
    monkeypatch.setattr(suffixes, "ANCHOR_SHARD_BYTES", size // 10)
    monkeypatch.setattr(suffixes, "SORT_SHARD_BYTES", size // 20)
    monkeypatch.setattr(suffixes, "HOT_BYTES", size // 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([(*r[:5], bytes(r[5])) for r in suffixes.suffix_dedup(df).collect()], removed(rows))
    parts = df.selectExpr(f"pmod(xxhash64(doc_id, text), {40}) part").groupBy("part").count().agg(F.max("count")).first()[0]
    assert parts < 2 * len(rows) / 40

    tables = []
    for k in range(40):
        mine = rows[k::40]
        tables.append(pa.table({
            "doc_id": pa.array([r[0] for r in mine], pa.int64()), "text": [r[1] for r in mine], "part": pa.array([k] * len(mine), pa.int64()),
        }))
    sent = pa.concat_tables([suffixes._send_anchors(t, 1) for t in tables])

    def largest(hot):
        """Bytes sent to the fullest of 20 shards, over their mean."""
        bits, held = suffixes._return_bits(sent, hot), Counter()
        for k, t in enumerate(tables):
            out = suffixes._send_segments(t, bits.filter(pc.equal(bits.column("part"), k)), 1, 20)
            for shard, cols in zip(out.column("key").to_pylist(), out.column("cols").to_pylist(), strict=True):
                if len(cols) == 6:
                    held[shard] += len(suffixes._loosen(cols[5], np.uint8))
        return max(held.values()) / (sum(held.values()) / 20)

    assert largest(size // 40) < 2 < largest(size)


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcd", bytes(range(256))])
def test_two_stage_order(letters):
    rng = np.random.default_rng(len(letters))
    for _ in range(30):
        text = rng.choice(np.frombuffer(letters, np.uint8), rng.integers(1, 400))
        text = np.concatenate([text, text[: rng.integers(0, len(text))], text])
        wanted = rng.random(len(text)) < 0.6
        order = suffixes.two_stage(text, wanted)
        whole = text.tobytes() + b"\0\xff" + bytes(80)
        keys = [whole[i : i + 50] for i in order]
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        assert keys == sorted(keys)


# --- 8 ---


def test_pieces(docs, rows, nothing):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for r in rows:
        ids = model.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((r[0], np.array(ids, "<u4").tobytes(), model.decode(ids)))
    same([(r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in pieces.encode(docs, path).collect()], want)
    assert pieces.encode(nothing, path).collect() == []


def test_pieces_of_odd_texts():
    import random

    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    letters = [*"abc XYZé ñß'st.,!?$…İΣ１23\n\t ▁中👍-_", "the ", "ing", "    ", "<s>", "<0x0A>", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [" " * n + "a" for n in range(40)] + ["▁" * n for n in range(40)]
    _, encoder, decoder = pieces._tools(path)
    flat, at = encoder.batch(pa.array(texts))
    for text, a, b, decoded in zip(texts, at[:-1], at[1:], decoder.batch(flat, at), strict=True):
        assert flat[a:b].tolist() == model.encode(text)
        assert decoded.decode() == model.decode(model.encode(text))


# --- 9 ---


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def base_spans(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, m.end()))
    return tuple(sorted(out))


def test_private_data(docs, rows, nothing, spark):
    many = " ".join(f"u{i}@h.org 10.{i % 256}.1.2" for i in range(700))
    more = spark.createDataFrame([(900, many), (901, "1.2.3.4" * 300), (902, "9" * 5000), (903, "+" + "1 " * 4000)], "doc_id long, text string")
    all_rows = [(r[0], r[1]) for r in rows] + [tuple(r) for r in more.collect()]
    out = private_data.find_private(docs.select("doc_id", "text").unionByName(more))
    got = [(r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 4)) for r in out.collect()]
    same(got, [(i, base_spans(t or "")) for i, t in all_rows])
    assert private_data.find_private(docs).count() == len(rows)
    assert private_data.find_private(nothing).collect() == []


def test_terms_that_reveal_an_entity(spark):
    rng = np.random.default_rng(3)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]

    def text(*middle):
        return " ".join([*rng.choice(filler, 20), *middle, *rng.choice(filler, 20)])

    data = [(i, text("Zacharias", "ann@mail.org")) for i in range(6)]
    data += [(10 + i, text("contact", "ann@mail.org")) for i in range(6)]
    data += [(30 + i, text("contact")) for i in range(40)]
    data += [(200, data[0][1])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == 4] for r in private_data.find_private(df).collect()}
    assert all("Zacharias" in found[i] for i in [*range(6), 200])
    assert all("contact" not in v for v in found.values())
    assert all(found[i] == [] for i in range(30, 70))
    clean = {r["doc_id"]: r["text"] for r in private_data.sanitise(df).collect()}
    assert "[TERM] [EMAIL]" in clean[0] and "ann@" not in clean[10]
    assert clean[30] == dict(data)[30]


def test_terms_far_from_the_entity(spark):
    rng = np.random.default_rng(5)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]

    def text(first, last):
        return " ".join([first, *rng.choice(filler, 60), last])

    data = [(i, text("Zacharias", "ann@mail.org")) for i in range(6)] + [(10 + i, text("Contact", "plain")) for i in range(60)]
    data += [(100 + i, "Melchior copied " + "x " * 90 + "bob@mail.org") for i in range(9)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = {r["doc_id"]: [s["value"] for s in r["spans"] if s["kind"] == 4] for r in private_data.find_private(df).collect()}
    assert all("Zacharias" in found[i] and "ann" not in found[i] for i in range(6))
    assert all(found[i] == [] for i in [*range(10, 70), *range(100, 109)])  # copies of one text are no support


# --- 10 ---


def rule(url):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, name in (
        ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")
    ):
        at, start = name.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(name) > len(best[0])):
            best = (name, verdict)
    return host, path, best


def test_url_filters(spark):
    urls = [
        "HTTP://WWW.Example.ORG/en/12?x#y", "https://example.org/es/", "https://example.org/en/2", "https://a.com/de/1",
        "https://a.com/fr/2.html", "https://notorg/x", "https://org/", "https://org", "no scheme", "", None, "x://h?q=://z/",
        "https://É.ORG/de", "a://b://c/d", "https://a.net/es/9", "https://a.net/en/9", "https://deep.net/a/b/c/d/e/f/1",
    ]
    urls += [f"https://c.org/en/{2 * 10**6 + i}" for i in range(30)]
    urls += [f"https://b.org/es/{i}" for i in range(9)] + [f"https://x.example.org/es/{i}" for i in range(40)]
    data = [(i, u, "<p>", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "<p>", "clash"), (None, urls[1], None, None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, host string")
    out = url_filters(df).collect()
    same(
        [(r["page_id"], r["host"], r["path"], r["rule"]) for r in out],
        [(d[0], *rule(d[1])[:2], (rule(d[1])[2] or [None])[0]) for d in data],
    )
    for r in out:
        assert r["verdict"] in ("allow", "block")
    by_url = {r["page_id"]: r for r in out}
    assert by_url[0]["verdict"] == "block" and by_url[2]["verdict"] == "allow"
    assert by_url[14]["verdict"] == "block" and by_url[15]["verdict"] == "allow"
    assert url_filters(df.where("false")).collect() == []


def test_many_children_become_a_wildcard(spark):
    urls = [f"https://a.net/shop/name{i}/view" for i in range(60)] + ["https://a.net/help/view"] * 30
    out = url_filters(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    by_id = {r["page_id"]: r["template"] for r in out}
    assert by_id[3] == "/shop/*/view" and by_id[70] == "/help/view"


def test_blocked_branches_are_not_pooled_with_unlabelled_ones(spark):
    urls = [f"https://a.com/de/{i}" for i in range(40)] + [f"https://a.com/fr/{i}" for i in range(300)]
    urls += [f"https://a.com/{x}{y}/{i}" for x in "ghiklm" for y in "xyz" for i in range(36)]
    out = url_filters(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    by_id = {r["page_id"]: r for r in out}
    assert by_id[0]["template"] == "/de/*" and by_id[50]["template"] == "/fr/*"
    assert {(by_id[i]["template"], by_id[i]["verdict"]) for i in range(340, len(urls))} == {("/*/*", "allow")}


def test_deep_paths(spark):
    start = "/a/b/c/d/e/f"
    urls = [f"https://a.net{start}/{x}/g" for x in ("es", "en")] * 20 + ["https://b.net"]
    rules = [("block", f"a.net{start}/es/"), ("allow", f"a.net{start}/en/")]
    out = url_filters(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by_id = {r["page_id"]: r for r in out}
    assert by_id[0]["template"] == f"{start}/es/g" and by_id[1]["template"] == f"{start}/en/g"
    assert by_id[0]["p_block"] > 0.5 > by_id[1]["p_block"] and by_id[40]["template"] == "/"


def test_words_stay_in_the_plan_without_python(docs, labels):
    for df in (quality_rules(docs, labels), private_data.find_private(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow(?!ToRow)", plan)
    assert docs.select(F.lit(1)).first()


def test_all_trusted_documents_count(spark):
    """Trust has no bound, however its ids meet the documents."""
    ids = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).unionByName(ids.select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).limit(2))
    docs = ids.unionByName(ids.limit(3)).unionByName(ids.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(1))
    for broadcast in (0, 10, 1000):
        out = with_trust(docs, labels, ["doc_id", "text"], broadcast)
        assert (out.count(), out.where("_trusted").count()) == (504, 503)
