"""Every operator against a brute-force version on texts with copies, near copies, shared passages, nulls and odd characters."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from geoloom.llm import ann, bpe, exchange, jaccard, langid, licenses, links, media, mixing, repeats, sharding, warc
from geoloom.llm.common import Stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, block int, score string, kept int, lang_pred int, __h string"


def texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [make(rng.randint(1, 300)) for _ in range(60)]
    for i in range(0, 20):  # near copies: some words changed
        w = out[i].split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    shared = make(120)
    out += [make(50) + "\n" + shared + "\n" + make(40) for _ in range(6)] + [shared + make(3), make(3) + shared[5:]]
    out += [out[0], out[0], out[1], "", "", " \t\n", "word", "a b", "a b", "x" * 5000, "x" * 4800 + "y", "ab" * 900, "　日本語 texts", "Licensed under the APACHE License, Version 2.0.\nCC BY! cc by", make(30_000), make(30_000)]
    return out


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "fr", None]
    t = texts()
    base = [(i, x, langs[i % 3], f"s{i % 5 if i % 2 else 0}", len(x), 1, "a", 2, "b", 3, 4, "h") for i, x in enumerate(t)]
    return base + [(len(t), None, "en", None, None, *[None] * 7), (None, t[2], None, "s1", None, *[None] * 7), base[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none, rows):
    got = sharding.shuffle_shards(docs, 7).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert sharding.shuffle_shards(none, 7).count() == 0


def test_communication_matrix():
    counts = [0, 5, 1000, 3, 77]
    m = sharding.communication_matrix(counts, 16, 1)
    assert m.sum(1).tolist() == counts and np.ptp(m.sum(0)) <= 1
    big = sharding.communication_matrix([800_000_000] * 3, 16, 1)
    assert big.sum() == 2_400_000_000 and np.ptp(big.sum(0)) <= 1


def test_mixing(docs, none, rows):
    got = mixing.mix_sources(docs, {"s0": 5.0, "s1": 1.0}, block_rows=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = {(r["source"], r["block"]): r["slot"] for r in got}
    assert sorted(slots.values()) == list(range(len(slots)))
    assert mixing.mix_sources(none).count() == 0
    assert mixing.in_mixed_order(docs).columns == docs.columns


@pytest.mark.parametrize("seed", range(5))
def test_pfair_deviation(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 9))}
    slots, total = mixing.period(weights), sum(weights.values())
    given = Counter()
    for k, s in enumerate(slots, 1):
        given[s] += 1
        assert all(abs(given[x] - k * a / total) < 1 for x, a in weights.items())


def test_mixing_targets():
    # op9's square-root targets with a hot source, small targets and one in a million, over a long run
    roots = {"hot": 4_000_000**0.5} | {f"s{i}": (400_000 + 997 * i) ** 0.5 for i in range(19)}
    small = {"a": 0.7, "b": 0.2996, "c": 0.0001, "d": 1e-6}
    for targets in (roots, small):
        whole = sum(map(Fraction, targets.values()))
        share = {s: Fraction(w) / whole for s, w in targets.items()}
        weights = mixing.integer_weights(targets)
        given = mixing.slots(weights, {s: int(150_000 * p) + 1 for s, p in share.items()})
        assert sorted(k for at in given.values() for k in at) == list(range(sum(map(len, given.values()))))
        first = min(at[-1] for s, at in given.items() if len(at) > 1)
        for s, at in given.items():
            for i, slot in enumerate(at):
                if slot > first:
                    break
                assert i - slot * share[s] < 1 and i + 1 - (slot + 1) * share[s] < 1 and (slot * share[s] - i) < 1


def test_mixing_plan(spark):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    targets = {"a": 0.0, "b": 0.9999}
    given = mixing.slots(mixing.integer_weights({"1a": Fraction(0.9999) / 1_000_000, "1b": 0.9999, "0": Fraction(0.9999) / 1_000_000}), {"1a": 1000, "1b": 250, "0": 250})
    got = mixing.mix_sources(df, targets, block_rows=2, run_blocks=16).collect()
    assert len(got) == 3000
    assert all(given["0" if r["source"] is None else "1" + r["source"]][r["block"]] == r["slot"] for r in got)


def test_licenses(docs, none, rows):
    got = {(r["doc_id"]): r for r in licenses.scan_licenses(docs).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    for i, text, *_ in rows:
        w, places, labels = word.findall((text or "").translate(low)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        found = set(labels)
        for line in (text or "").split("\n"):
            s = set(word.findall(line.translate(low)))
            found |= {k for k, t in licenses.TEMPLATES.items() if len(s & set(t.split())) >= 0.8 * len(set(t.split()))}
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and r["labels"] == ",".join(sorted(found)) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(none).count() == 0


def test_wrapped_licenses(spark):
    wrapped = {
        "bsd-notice": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mpl-notice": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy",
        "lgpl-notice": "This library is free software; under the\nGNU Lesser General\nPublic License",
    }
    apart = "\n".join(w + " x" * 13 for w in licenses.TEMPLATES["bsd-notice"].split())
    one_line = apart.replace("\n", " ")  # words of one line, however far apart, match as before
    df = spark.createDataFrame([*wrapped.items(), ("", apart), ("bsd-notice ", one_line)], "doc_id string, text string")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == 5 and all(r["labels"] == r["doc_id"].strip() and (r["score"] >= 0.8) == bool(r["labels"]) for r in got)


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none, rows, reference):
    # chunks of 1,000 characters: most texts take the chunked way
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=1000, overlap=50).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    want = {r[0]: reference.encode_ordinary(r[1] or "") for r in rows}
    for r in got:
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    plain = {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows}
    assert all(r["decoded_sha256"] == plain[r["doc_id"]] for r in got)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_stitching(reference):
    codec, rng = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN), random.Random(1)
    signs = "ab é'sre  \n\t\r\x1c\x1f\x85 　 12٣½Ⅷ!?-—中日\U0001f600​ñÑ_ǅ"
    for _ in range(400):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 150))) + rng.choice(" a1!") * rng.randint(0, 60)
        for chunk, overlap in ((16, 8), (7, 3), (30, 12)):
            assert np.frombuffer(b"".join(bpe.encode_text(t, codec, chunk, overlap)), "<u4").tolist() == reference.encode_ordinary(t)


def test_media(docs, none, rows):
    got = {r["doc_id"]: r for r in media.store_and_read(docs).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["payload_sha256"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]), hashlib.sha256(payload).hexdigest())
    assert media.store_and_read(none).count() == 0


def test_sniffing(spark):
    png, wav = media.png_of(b"p" * 64), media.wav_of(b"w" * 64)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = gz.compress(b"z" * 99) + gz.flush()
    broken = png[:-5] + b"xxxxx"
    values = [(1, png, "image/png"), (2, wav, "image/png"), (3, b"junk" + png + b"GIF89a" + gif, "x"), (4, broken, "image/png"), (5, None, "a"), (6, b"", "a"), (7, media.wav_of(png + gz), "audio/wav"), (8, gif, None)]
    got = {r["k"]: r for r in media.sniff_media(spark.createDataFrame(values, "k int, c binary, d string"), "c", "d", key="k").collect()}
    assert (got[1]["kind"], got[1]["corrected"], got[1]["length"]) == ("image/png", False, len(png))
    assert (got[2]["kind"], got[2]["corrected"]) == ("audio/wav", True)
    assert [(c["at"], c["kind"]) for c in got[3]["carved"]] == [(4, "image/png"), (4 + len(png) + 6, "image/gif")] and got[3]["kind"] == "x"
    assert (got[4]["kind"], got[4]["carved"]) == ("image/png", []) and got[5]["kind"] is None and got[6]["kind"] == "a"
    assert [c["kind"] for c in got[7]["carved"]] == ["image/png", "application/gzip"] and got[8]["kind"] == "image/gif"


def test_warc(spark):
    html = ["x" * 200, "y" * 300, None, "", "short", "é" * 60]
    rows = [(i, f"http://a/{i}", html[i % 6], "extra") for i in range(40)] + [(None, None, "x" * 200, "e"), (0, "http://a/0", "x" * 200, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string")
    got = warc.read_archives(Stages(spark, "t").keep(warc.write_archives(pages), "a")).collect()
    assert len(got) == len(rows) and {r["kind"] for r in got} == {"record"}
    head = {}
    for i, _, h, _ in rows:
        if i is not None:
            head[h] = min(head.get(h, i), i)
    text = {i: h for i, _, h, _ in rows}
    for r in got:
        raw = (text[r["page_id"]] or "").encode()
        first = head[text[r["page_id"]]]
        revisit = len(raw) >= 100 and first != r["page_id"]
        assert r["payload_digest"] == hashlib.sha256(raw).hexdigest() and r["payload_bytes"] == len(raw)
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_salvage():
    raw = [warc.record(i, "u", b"p%d" % i * 50, hashlib.sha256(b"p%d" % i * 50).hexdigest(), None) for i in range(5)]
    packed = [warc.member(r) for r in raw]
    for parts in (packed, raw):
        damaged = parts[0] + b"garbage" + parts[1] + parts[2][:-30] + parts[3][:40] + b"\0" * 9 + parts[4]
        found = list(warc.salvage(damaged))
        assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:4>"]
        assert sum(e - s for _, s, e, _, _ in found) == len(damaged) and [x[0] for x in found] == ["record", "gap", "record", "gap", "record"]
    assert [x[0] for x in warc.salvage(b"nothing")] == ["gap"] and list(warc.salvage(b"")) == []


@pytest.mark.parametrize("least", [400])
def test_repeats(docs, none, rows, least):
    raw = [(r[1] or "").encode() for r in rows]
    count = Counter(b[k : k + least] for b in raw for k in range(len(b) - least + 1))
    want = Counter()
    for r, b in zip(rows, raw, strict=True):
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if count[b[k : k + least]] > 1:
                cover[k : k + least] = True
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        want[r[0], int(cover.sum()), runs, np.frombuffer(b, np.uint8)[~cover].tobytes()] += 1
    got = repeats.dedupe(docs.repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert repeats.dedupe(none).count() == 0


def test_two_level_exchange(spark, docs, none, rows, monkeypatch):
    """Beyond DIRECT buckets answers come through groups of shards; the results are the same."""
    def shapes(df):
        return Counter((r["doc_id"], r["n_removed"], r["n_passage_words"], bytes(r["kept"])) for r in df.collect())

    df = docs.repartition(6)
    one, classes = shapes(repeats.dedupe(df, words=50)), Counter(tuple(r) for r in jaccard.classes(df).collect())
    monkeypatch.setattr(exchange, "DIRECT", 3)
    assert exchange.ranges(12) == 4
    assert shapes(repeats.dedupe(df, words=50)) == one
    assert Counter(tuple(r) for r in jaccard.classes(df).collect()) == classes
    assert repeats.dedupe(none, words=50).count() == 0


def test_passages(spark, none):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, make(rng.randint(0, 400))) for i in range(60)]
    for n in [*range(48, 61), 120]:  # passages of about 50 words, most of fewer than 400 bytes, and one of "a" only
        shared = make(n) if n != 55 else " ".join("a" * 55)
        rows += [(len(rows) + k, f"{make(30)} {shared}\n{make(20 * k)}") for k in range(2 + n % 3)]
    own = make(120)
    rows += [(500, f"{own} {make(10)} {own}"), (501, None), (502, "")]  # repeats within one document only
    words = [(r[1] or "").split() for r in rows]
    holders = defaultdict(set)
    for i, (_, t) in enumerate(rows):
        for m in re.finditer(r"(?=(?<!\S)((?:\S+\s+){49}\S+)(?!\S))", t or ""):
            holders[m[1]].add(i)
    want = {}
    for i, (k, t) in enumerate(rows):
        cover = np.zeros(len(t or ""), bool)
        for m in re.finditer(r"(?=(?<!\S)((?:\S+\s+){49}\S+)(?!\S))", t or ""):
            if len(holders[m[1]]) > 1:
                cover[m.start() : m.start() + len(m[1])] = True
        starts = [m.start() for m in re.finditer(r"\S+", t or "")]
        want[k] = (sum(bool(cover[x]) for x in starts), "".join(c for c, x in zip(t or "", cover, strict=True) if not x))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in repeats.dedupe(df, words=50, cut_passages=True, as_text=True, least=4000).collect()}
    assert {k: (r["n_passage_words"], r["kept"]) for k, r in got.items()} == want and len(words) == len(got)
    assert sum(n > 0 for n, _ in want.values()) >= 25 and want[500][0] == 0
    plain = {r["doc_id"]: r for r in repeats.dedupe(df, words=50).collect()}
    assert all(plain[k]["n_passage_words"] == want[k][0] for k in want) and plain[500]["n_removed"] > 0
    assert repeats.dedupe(none, words=50).count() == 0
    left = repeats.without_repeats(df)
    assert left.columns == ["doc_id", "text"] and {r["doc_id"]: r["text"] for r in left.collect()}[501] is None


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(docs, none, rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = Counter((r[0], len(sets[i]), min(least[find(i)], default=None) if sets[i] else r[0]) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in jaccard.classes(docs).collect()) == want
    assert jaccard.classes(none).count() == 0
    # of each class one row stays, the one with the least id; rows without shingles all stay
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else ("alone", i)].append(r)
    first = Counter((min(g, key=lambda r: (r[0] is None, r[0]))[:2]) for g in groups.values())
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == first
    assert jaccard.one_of_each(none).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, "q " + b), (None, a), (None, "z " + b), (3, ""), (3, None), (None, "")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, a), (1, b), (3, ""), (3, None), (None, "")])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["comp"] for r in links.components(Stages(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    for a, b in edges:
        assert a == b or got[a] == got[b]
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 160))


def test_language(spark, sf, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table.where(~langid.held_out()))
    got = langid.identify(table, model).where(langid.held_out()).select("lang", "lang_pred", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and sum(r["rejected"] for r in got) <= 0.01 * len(got)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)
    strange = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita e quanto a dir qual era", "W tym roku zima przyszła bardzo wcześnie i wszystkie drogi były zasypane śniegiem aż do końca miesiąca", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlIHNpeHR5IGZvdXIgdGV4dCB3aXRob3V0IG1lYW5pbmcgYXQgYWxsIGhlcmU",
    ]
    assert all(model.predict(strange)[2])
    odd = langid.identify(docs, model).select("text", "lang_pred", "score", "rejected").collect()
    for r in odd:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and (letters or r["rejected"])
    # probabilities of a language's next letters sum to one
    context = np.int64(3) << langid.BITS | 4
    total = np.exp(model.lookup(context << langid.BITS | np.arange(model.alphabet.size), 3)).sum(axis=0)
    assert np.allclose(total, 1, atol=0.02)
    assert langid.train(none) is None and langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("leaf_most", [4000, 60])
def test_neighbours(spark, leaf_most):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[100:1100] = x[100]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in p], i) for i, p in enumerate(x)]
    odd = [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [1.0, None], 0), (None, [1.0] * 16, 0), (5400, [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in ann.search(df, "id % 100 = 0", fit_rows=1500, leaf_rows=40 if leaf_most > 3000 else 400, block_rows=500, leaf_most=leaf_most).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    hits = 0
    assert len(got) == 30
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [(d[i], i) for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert found == sorted(found) and len(found) == 10
        hits += len(set(found) & set(want))
    assert hits >= 0.9 * 300
    assert ann.search(df.limit(0), "id % 100 = 0").count() == 0


def near_groups(rows):
    """Lists of rows linked by shingles; rows without shingles stand alone."""
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else ("alone", i)].append(r)
    return list(groups.values())


def without_passages(rows, least=400, words=50):
    """Texts without the bytes that repeated strings and passages cover; rows of which nothing is left go."""
    raw = [(r[1] or "").encode() for r in rows]
    count = Counter(b[k : k + least] for b in raw for k in range(len(b) - least + 1))
    windows, holders = [], defaultdict(set)
    for i, b in enumerate(raw):
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        windows.append([(at[k][0], at[k + words - 1][1]) for k in range(len(at) - words + 1)])
        for x, y in windows[-1]:
            holders[b[x:y]].add(i)
    out = []
    for r, b, mine in zip(rows, raw, windows, strict=True):
        cover = np.zeros(len(b), bool)
        for x, y in [(k, k + least) for k in range(len(b) - least + 1) if count[b[k : k + least]] > 1] + [w for w in mine if len(holders[b[w[0] : w[1]]]) > 1]:
            cover[x:y] = True
        left = np.frombuffer(b, np.uint8)[~cover].tobytes().decode("utf-8", "ignore")
        if not cover.any() or left:
            out.append((r[0], left if cover.any() else r[1], *r[2:]))
    return out


def test_pipeline_against_brute_force(spark, rows, reference):
    import corpus_pipeline

    root = Stages(spark, "t").root
    more = [(900 + k, f"{rows[k][1]} {' '.join(f'tail{k}x{i}' for i in range(40))}", "en", "s1", 5, *[None] * 7) for k in (3, 4)]
    docs = spark.createDataFrame([*rows, *more], SCHEMA).repartition(3)
    docs.write.parquet(f"{root}/documents.parquet")
    kept = [tuple(r) for r in langid.recognised(spark.read.parquet(f"{root}/documents.parquet")).collect()]
    assert not Counter(kept) - Counter([*rows, *more]) and all(any(c.isalpha() for c in r[1]) for r in kept)
    # of equal ids and texts any of the rows may stay
    first = [min(g, key=lambda r: (r[0] is None, r[0])) for g in near_groups(kept)]
    left = without_passages(first)
    want = Counter((r[0], hashlib.sha256(np.array(reference.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest()) for r in left)
    got = corpus_pipeline.run(spark, root).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got) == want
    assert sorted(r["rank"] for r in got) == list(range(len(left)))
    none = Stages(spark, "t").root
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = Stages(spark, "t")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stages.keep(stage(spark, docs, sf), name)
        seen.append(out.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert seen == sorted(seen, reverse=True) and seen[2] == seen[3] == seen[4]
    near = {r["doc_id"] for r in jaccard.classes(spark.read.parquet(f"{sf}/documents.parquet")).where(F.col("doc_id") == F.col("component_id")).collect()}
    assert {r["doc_id"] for r in docs.collect()} <= near


def test_pipeline_mix(spark, monkeypatch):
    import corpus_pipeline

    # the mix and what follows; the last text is cut into chunks
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    rows = [(i, f"text {i} " * (20_000 if i == 999 else 1), f"s{i % 4 if i % 2 else 0}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    root = Stages(spark, "t").root
    docs.write.parquet(f"{root}/documents.parquet")
    seen = []
    for targets in (None, {"s0": 1.0, "s1": 3.0, "s3": 9.0}):
        monkeypatch.setattr(corpus_pipeline, "TARGETS", targets)
        got = corpus_pipeline.run(spark, root).select("doc_id", "rank", "n_tokens").collect()
        assert sorted(r["rank"] for r in got) == list(range(1000)) and all(r["n_tokens"] for r in got)
        mixed = mixing.mix_sources(docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns}), targets, source="c_source").orderBy("slot", "place").collect()
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [r["c_doc_id"] for r in mixed]
        seen.append({(r["doc_id"], r["rank"]) for r in got})
    assert seen[0] != seen[1]


def test_rank_of_files():
    names = ["part-00000-a-c000.x", "part-00002-a-c000.x", "part-00002-a-c001.x", "part-00010-a-c000.x", "part-99999-a-c000.x", "part-100000-a-c000.x"]
    assert sorted(reversed([f"file:/t/{n}" for n in names]), key=mixing.part_number) == [f"file:/t/{n}" for n in names]
