"""The ten operators and the pipeline against brute-force versions on small, awkward tables."""

from __future__ import annotations

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelab.llm import decontaminate, language, licenses, media, neardup, packing, pii, quality, queries, sharding, webtext

SMALL = "/root/testdata/sf0.001"
WORDS = "amber basin cedar delta ember frost grove haven inlet jetty knoll lemon marsh nectar ocean pearl quartz river stone tulip umber valley willow yarrow zephyr".split()
#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key binary, sig binary, label string, bucket int, h long, i long, unit int, shard int, rep long, _i long, _h long, _kept long, _again int, words string, score double"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), b"k", b"s", "x", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, "w", 0.5) for i, t, lang in rows], SCHEMA)


def awkward():
    """Nulls, empty texts, a very long text, ties, copies, near copies in groups, repeated rows."""
    base, r = prose(1, 120), random.Random(5)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "de"), (5, "ONE", "de"), (6, "one two three four five six", "fr"), (7, prose(2, 30_000), "en"), (None, base, "en"), (8, base, "en"), (9, base.upper(), None), (8, base, "en")]
    for k in range(40):
        words = base.split()
        for _ in range(k // 4):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((100 + k, " ".join(words), "en"))
    rows += [(200 + k, prose(300 + k % 7, 60) + " end" * (k % 3), "de") for k in range(30)]
    rows += [(300, "été 中文 \U0001f600 naïve\x1cx <|endoftext|> it's", "fr"), (301, "a\u0000b", "en")]
    return rows


def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets if i is not None}
    links = [(a, b) for a in label for b in label if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: len(s) for i, s in sets.items()}, label


def test_near_duplicates(spark):
    rows = awkward()
    n, label = brute_components(rows)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == n[r.doc_id]
        assert r.component_id == label.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    kept = neardup.deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == sorted(i for i, c in label.items() if i == c)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert neardup.deduplicated(frame(spark, [])).count() == 0


def test_a_group_whose_members_are_unlike_each_other(spark):
    """A chain: neighbours are similar, ends are not."""
    words, rows = prose(9, 100).split(), []
    for k in range(25):
        words = words[3:] + prose(1000 + k, 3).split()
        rows.append((50 - k, " ".join(words), "en"))
    _, label = brute_components(rows)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows)).collect()} == label


def test_pruning_bound():
    assert [neardup.least_matches(n) for n in (32, 64, 96, 128)] == sorted(neardup.least_matches(n) for n in (32, 64, 96, 128))
    assert all(neardup.least_matches(n) < 0.75 * n for n in (32, 64, 96, 128))


def test_media(spark):
    rows = awkward()
    for r in media.fingerprint(media.encode(frame(spark, rows))).collect():
        texts = {t for i, t, _ in rows if i == r.doc_id}
        payload = media.padded((texts.pop() or "").encode())
        assert len(payload) % 192 == 0 and r.payload_bytes == len(payload) > 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.wav_bytes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.wav_payload(stored) == payload and wave.open(io.BytesIO(stored)).getsampwidth() == 1
        assert all(a <= b for a, b in zip(r.codes, r.codes[1:]))
    same = {r.feature for r in media.fingerprint(media.encode(frame(spark, [(1, "ab c", "en"), (2, "ab c", "de")]))).collect()}
    assert len(same) == 1
    assert media.fingerprint(media.encode(frame(spark, []))).count() == 0


def test_media_peaks_of_a_tone():
    """A tone with 16 periods a block has its peaks in bin 16."""
    t = np.arange(192 * 40)
    x = np.round(128 + 90 * np.sin(2 * np.pi * 16 * t / 192) * (1 + 0.3 * np.sin(t / 500))).astype(np.uint8)
    c = media.codes(x.tobytes())
    assert len(c) and Counter((c >> 13 & 127).tolist()).most_common(1)[0][0] == 16


def test_quality(spark):
    good = [(i, "\n".join(prose(i * 7 + k, 15).capitalize() + "." for k in range(4)), "en") for i in range(150)]
    bad = [(200 + i, "\n".join(" | ".join(w + "###" for w in prose(i * 5 + k, 12).split()) for k in range(4)), "en") for i in range(150)]
    docs = frame(spark, good + bad + [(900, None, "en"), (901, "", None), (None, "x", "en")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 1) for i, _, _ in bad] + [(1, 1, 0), (None, 1, 0), (77, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert all(got[i].predicted == 1 for i, _, _ in good) and all(got[i].predicted == 0 for i, _, _ in bad)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, _, _ in good}
    untaught = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.scored(docs, untaught).collect()} == {0.5}
    assert quality.scored(frame(spark, []), quality.train(frame(spark, []), labels)).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    s, move = rng.normal(size=6), rng.normal(size=(2, 2))
    p, total = np.zeros(6), 0.0
    for mask in range(64):
        y = [mask >> k & 1 for k in range(6)]
        w = np.exp(sum(s[k] for k in range(6) if y[k]) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
    assert quality.marginals(s, move) == pytest.approx(p / total)
    z, ds, dm = quality._log_partition(s[:, None], move, np.ones((6, 1), bool))
    assert z == pytest.approx(np.log(total)) and ds[:, 0] == pytest.approx(p / total) and dm.sum() == pytest.approx(5)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.95 * got.count()


def test_language(spark):
    rows = [(i, " ".join(random.Random(i).choice(["der", "und", "nicht", "schule", "ung"]) for _ in range(9)), "de") for i in range(60)]
    rows += [(100 + i, " ".join(random.Random(i).choice(["the", "and", "not", "school", "ing"]) for _ in range(9)), "en") for i in range(60)]
    odd = [(300, None, "en"), (301, "123 !?", "de"), (302, "schulung", None), (303, "schooling", None), (None, "und der", "de")]
    docs = frame(spark, rows + odd)
    got = {r.doc_id: r for r in language.predicted(docs, language.train(docs)).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert got[300].lang_pred == got[301].lang_pred == "und" and (got[302].lang_pred, got[303].lang_pred) == ("de", "en") and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    untaught = language.train(frame(spark, []))
    assert {r.lang_pred for r in language.predicted(docs, untaught).collect()} == {"und"}


def test_a_small_language_beside_a_large_one(spark, monkeypatch):
    """Every language has documents of its own in the sample, and all their words are counted."""
    monkeypatch.setattr(language, "SAMPLE", 200)
    ids = spark.range(100_000, 110_000).where("crc32(cast(cast(id as string) as binary)) % 3 <> 1 and pmod(xxhash64(id), 1000000) >= 900000").limit(6)
    few = ids.selectExpr("id as doc_id", "'xx' as lang", "'жук лес дом' as text")
    many = spark.range(40_000).selectExpr("id as doc_id", "'en' as lang", "concat_ws(' ', transform(sequence(1, 5), k -> translate(cast((id * 5 + k) % 300 as string), '0123456789', 'abcdefghij'))) as text")
    assert language.learnable(many.unionByName(few)).groupBy("lang").count().orderBy("lang").collect() == [("en", 200), ("xx", 6)]
    model = language.train(many.unionByName(few))
    assert model["langs"] == ["en", "xx"] and {"жук", "лес", "дом"} <= set(model["words"]) and {"<жук"[:4], "лес>"} <= set(model["grams"])
    assert language.Scorer(model)("жук дом")[0] == "xx" and language.Scorer(model)("abc bcd")[0] == "en"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predicted(docs, language.train(docs)).join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()


def brute_private(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, hit):
        d = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(x) <= 255 for x in hit.split("."))
        if kind == "card":
            twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if valid(k, m[0])]


ODD_PRIVATE = ["", "a@b.c%d@e.f.g x..@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111, 5 4111111111111112", "+1 (555) 123-4567 +1- +12 3456789 +1234567890123456", "é\U0001f600 x@y.zz 中 9.9.9.9\n\n\r\n a@b.cd", "1" * 3000 + "a" * 3000, "@@ a@ @b.c a@b a@b.c-d_e@f.gh", "12 34 56 78 90 12 34 5" * 30]


def test_private_spans(spark):
    r = random.Random(3)
    texts = ODD_PRIVATE + ["".join(r.choice("ab1259.@+- ()%\n_") for _ in range(300)) for _ in range(150)]
    got = pii.private_spans(frame(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, None, "en")])).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        want = brute_private(texts[row.doc_id] if row.doc_id is not None else "")
        assert [tuple(x) for x in row.spans] == want, texts[row.doc_id]


def test_revealing_terms(spark):
    """A word that stands with one address alone, in different contexts, gives it away; common words and copies don't."""
    r = random.Random(8)
    fill = lambda: " ".join(r.choice(WORDS) for _ in range(6))
    rows = [(i, f"{fill()} wizzlebeck mails jo@ex.org about {fill()}", "en") for i in range(6)]
    rows += [(20 + i, f"{fill()} only snorkelwade copied ed@ex.org {WORDS[3]}", "en") for i in range(1)] * 1
    same = f"{fill()} snorkelwade copied ed@ex.org {WORDS[3]}"
    rows += [(30 + i, same, "en") for i in range(9)] + [(100 + i, f"{fill()} mails about {fill()}", "en") for i in range(200)]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in pii.private_spans(docs).collect()}
    text = dict((i, t) for i, t, _ in rows)
    for i in range(6):
        assert [text[i][t.s : t.e] for t in got[i].terms] == ["wizzlebeck"]
    assert not any(got[i].terms for i in got if i >= 20)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    for x in clean.collect():
        assert "@" not in x.text and "wizzlebeck" not in x.text
        assert x.text == text[x.doc_id] or x.doc_id < 50
    assert "mails [EMAIL] about" in clean.where("doc_id = 2").first().text


def test_revealing_terms_everywhere(spark):
    """A revealing word goes at all its places: far from the address, and in texts without it. One line in several texts is support."""
    r = random.Random(11)
    fill = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    line = "Wizzlebeck mails jo@ex.org about ember"
    rows = [(i, f"{fill(30)} WIZZLEBECK\n{fill(30)}\n{line}\nwizzlebeck@else.net", "en") for i in range(4)]
    rows += [(10, f"{fill(5)}\nwizzlebeck wizzlebecks {fill(5)}", "en"), (None, "saw wizzlebeck", "en"), (None, "saw wizzlebeck", "en")]
    rows += [(100 + i, fill(12) + " mails about", "en") for i in range(3000)]
    got = pii.private_spans(frame(spark, rows)).where("size(terms) > 0").collect()
    text = dict((i, t) for i, t, _ in rows)
    assert sorted((str(x.doc_id), len(x.terms)) for x in got) == [("0", 3), ("1", 3), ("10", 1), ("2", 3), ("3", 3), ("None", 1), ("None", 1)]
    assert all(text[x.doc_id][t.s : t.e].lower() == "wizzlebeck" for x in got for t in x.terms)
    clean = {x.doc_id: x.text for x in pii.sanitised(frame(spark, rows)).where("doc_id is null or doc_id < 100").collect()}
    assert not any(re.search(r"wizzlebeck\b|@", t, re.I) for t in clean.values())
    assert clean[None] == "saw [TERM]" and "[TERM] wizzlebecks" in clean[10] and clean[0].endswith("[TERM] mails [EMAIL] about ember\n[EMAIL]")


def test_sanitised_keeps_rows_and_overlaps(spark):
    rows = [(1, "call +1 555 123 4567 8901 now a@1.2.3.4", "en"), (1, "call +1 555 123 4567 8901 now a@1.2.3.4", "en"), (None, "x a@b.cd", "en"), (2, None, "en"), (3, "plain", "en")]
    out = sorted((str(r.doc_id), str(r.text)) for r in pii.sanitised(frame(spark, rows)).collect())
    assert out[-1] == ("None", "x [EMAIL]") and ("2", "None") in out and ("3", "plain") in out
    assert [t for i, t in out if i == "1"] == ["call [PHONE] now [EMAIL]"] * 2
    assert pii.sanitised(frame(spark, [])).count() == 0


def test_licenses_against_sql(spark):
    texts = ["", "CC BY cc by 4.0 cc-by", "General Public License general  public\nlicense", "all rights reserved ALL RIGHTS RESERVED. all rights", "Released under the MIT License.", "released mit license under nothing the", "license mit", "é cc byé", "Licensed under the Apache License, Version 2.0\nand more", "x" * 70000 + " cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(50, None, "en")]
    got = licenses.scanned(frame(spark, rows))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [(i, t) for i, t, _ in rows])
    cur = c.execute(licenses.SQL)
    cols = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r[k] for k in cols) for r in got.collect()))) == sorted(map(str, cur.fetchall()))
    assert licenses.scanned(frame(spark, [])).count() == 0
    assert {r.labels for r in got.where("doc_id in (4, 5)").collect()} == {"mit"}


def check_packed(spark, rows):
    tok = packing._tokenizer(packing.default_tokenizer())
    got = packing.pack(packing.pieces(frame(spark, rows), keep_ids=False)).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want[i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    at: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 for n in at.values()) and sorted(at) == list(range(len(at)))
    return at


def test_packing(spark):
    check_packed(spark, awkward())
    assert packing.pack(packing.pieces(frame(spark, []))).count() == 0
    at = check_packed(spark, [(i, prose(i, 20 + i % 300), "en") for i in range(500)])
    assert sum(at.values()) > 0.93 * 4096 * len(at)


def test_patterns_hold_every_piece():
    r = random.Random(4)
    h = {r.randrange(1, 90): r.randrange(1, 3000) for _ in range(70)}
    held: Counter = Counter()
    out = packing.patterns(h)
    for times, own in out:
        assert times > 0 and sum(s * a for s, a in own.items()) <= 256
        for s, a in own.items():
            held[s] += times * a
    assert held == h
    assert sum(t for t, _ in out) <= 1.02 * sum(s * n for s, n in h.items()) / 256 + 60
    assert packing.patterns({}) == []


def test_kept_ids(spark):
    for r in packing.pieces(frame(spark, awkward()[:8])).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_sharding(spark):
    for rows in (awkward(), [(i, "same", "en") for i in range(70)] + [(100 + i, str(i), "en") for i in range(60)], awkward()[:5]):
        got = sharding.sharded(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        slots: dict = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
        sizes = [len(slots.get(k, [])) for k in range(16)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.sharded(frame(spark, [])).count() == 0


def test_linked_documents_come_together(spark):
    """Votes against a plain count; documents of one line family move together, equal texts are never cut."""
    families = [f"a line that family {k} shares" for k in range(20)]
    rows = [(i, f"own line of document {i}\n{families[i % 20]}\nshort", "en") for i in range(400)] + [(1000 + i, "the same text\nover and over again, twice", "en") for i in range(12)]
    docs = frame(spark, rows)
    located, state = sharding.units(sharding.described(docs).cache(), 16)
    linked = sharding.links(docs, state)
    unit = {r.doc_id: r.u for r in located.collect()}
    at = {r.u: (r.shard, r.n) for r in state.collect()}
    got = {r.u: r.votes for r in sharding.votes(state, linked, 16, None, None).collect()}
    assert set(got) == {unit[i] for i, _, _ in rows if i < 1000}
    for i in range(0, 400, 37):
        want = [sum(at[unit[j]][1] for j in range(i % 20, 400, 20) if j != i and at[unit[j]][0] == k) / 20 for k in range(16)]
        assert np.allclose(got[unit[i]], want)
    kept = []
    for rounds in (0, 8):
        shard = {r.doc_id: r.shard for r in sharding.sharded(docs, rounds=rounds).collect()}
        assert len({shard[i] for i, _, _ in rows if i >= 1000}) == 1
        sizes = Counter(shard.values())
        assert max(sizes.values()) - min(sizes.values()) <= 1
        kept.append(sum(max(Counter(shard[j] for j in range(k, 400, 20)).values()) for k in range(20)))
    assert kept[0] < 120 and kept[1] > 200  # of 400 that could be beside their family


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="layout"><aside class="sidebar">Popular</aside><article><header><h1>Title &amp; {n}</h1></header><p>First  <b>bold</b> {n}&eacute;<p>Second<br>line {n}</p><div class="share">Share</div></article>
<section id="comments"><p>Nice {n}!</p></section></div><form><input value=x>Search</form><div class="box">Same text everywhere</div><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"https://Www.a.example/{i}", PAGE.replace("{n}", str(i))) for i in range(60)]
    pages += [(100, "http://b.example", "<article><p>Only"), (101, None, None), (102, "nonsense", ""), (103, "http://b.example/2", "a < b <p>c <!-- x"), (104, "http://c.example", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*p, "clash", "x") for p in pages], "page_id long, url string, html string, host string, low string")
    got = {r.page_id: r for r in webtext.main_text(df).collect()}
    assert len(got) == len(pages)
    for i in range(60):
        assert got[i].text == f"Title & {i}\nFirst bold {i}é\nSecond line {i}" and got[i].url == pages[i][1]
    assert (got[100].text, got[101].text, got[102].text, got[103].text, got[104].text) == ("Only", "", "", "a < b\nc", "deep")
    assert webtext.main_text(df.where("false")).count() == 0


def test_names_of_noise_and_of_whole_pages():
    text = lambda h: webtext.blocks(webtext.parse(h), set())
    assert text('<body class="has-sidebar"><div class="page-with-sidebar"><article class="post ad-free">A</article></div><div class="topnav">N</div><p>B') == ["A", "B"]
    for name in ("ad", "sidebar left", "site-footer", "cookie-banner", "reader-comments", "top_menu", "related-posts"):
        assert text(f'<div class="{name}"><p>x</p></div><p>y</p>') == ["y"], name
    for name in ("article-header", "post-content", "entry-title", "story", "headline"):
        assert text(f'<div class="{name}">x</div>') == ["x"], name
    assert text("<p>a<script>if (a < b) '</p>'</script>b<style>p</style><p hidden>c") == ["ab"]


def test_a_site_of_copies_keeps_its_article(spark):
    df = spark.createDataFrame([(i, "http://a.example", PAGE.replace("{n}", "7")) for i in range(80)], "page_id long, url string, html string")
    assert {r.text for r in webtext.main_text(df).collect()} == {"Title & 7\nFirst bold 7é\nSecond line 7\nSame text everywhere"}


def test_decontamination(spark):
    r = random.Random(6)
    items = [(i, prose(500 + i, 8 + i % 20)) for i in range(40)] + [(90, "tiny"), (91, ""), (92, None), (93, items_text := prose(501, 9)), (93, items_text)]
    rows = awkward()
    planted = []
    for k, (i, t) in enumerate(items[:40]):
        edits = min(len(t) // 10, (len(t) - 8) // 8)
        s = list(t)
        for _ in range(edits * (k % 4) // 4):
            p = r.randrange(len(s))
            s[p : p + 1] = r.choice([["q"], [s[p], "q"], []])
        body = "".join(s).upper().replace(" ", "  ") if k % 3 == 0 else "".join(s)
        rows.append((1000 + k, f"{prose(k, 30)}\n{body} {prose(k + 50, 30)}", "en"))
        planted.append((1000 + k, i))
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert found >= set(planted) and all(d >= 1000 for d, _ in found)
    text = {i: t for i, t, _ in rows}
    for x in got:
        if x.edits == 0:
            assert re.sub(r"\s+", " ", text[x.doc_id][x.start : x.end].lower()) == dict(items[:41])[x.item_id] or x.item_id == 93
    clean = decontaminate.uncontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(i) for i, _, _ in rows if i is None or i < 1000)
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_align_by_full_table():
    r = random.Random(2)
    for _ in range(60):
        item = np.array([r.randrange(3) for _ in range(r.randrange(8, 30))], np.uint32)
        text = np.array([r.randrange(3) for _ in range(r.randrange(5, 50))], np.uint32)
        row = np.zeros(len(text) + 1, int)
        for c in item:
            new = [row[0] + 1]
            for j in range(len(text)):
                new.append(min(row[j] + (text[j] != c), row[j + 1] + 1, new[j] + 1))
            row = np.array(new)
        got = decontaminate.align(item, text, -len(item), len(text), len(item))
        assert got is not None and got[0] == row.min() and row[got[1]] == row.min()


def test_queries_and_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL).cache()
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        docs = after
    ids = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == ids
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert not any(brute_private(r.text) for r in docs.collect())
