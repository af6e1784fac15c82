"""Operators that work row by row or task by task, against plain Python."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import fingerprints, language, lmscore, media, mixing, packing, sharding, tokens, webarchive
from corpuscope.shared import new_path, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"), (2, "der schnelle braune fuchs springt über den faulen hund", "de", "b"),
    (3, None, "en", None), (4, "", None, "a"), (5, "123 !!", "en", "b"), (6, "the quick brown fox " * 400, "en", "a"), (7, "the quick brown fox jumps over the lazy dog again and again", "en", "c"),
    (7, "the quick brown fox jumps over the lazy dog again and again", "en", "c"), (None, "ohne nummer", "de", "a"), (9, "naïve 日本語 \U0001f600 <|endoftext|> İx", "xx", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), 1, "x") for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score string").repartition(3).cache()


def test_sharding(docs):
    rows = written(sharding.records(docs), "r")
    m = sharding.SlotMap.initial().measured(sharding.per_slot(rows))
    got = sharding.placed(rows, m.rebalanced()).collect()
    assert len(got) == len(TEXTS)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    want = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for _, t, *_ in TEXTS)
    assert sorted((r.text_crc32, r["size"]) for r in got) == want
    assert sharding.placed(rows.limit(0), m).count() == 0


def test_sharding_of_a_hot_slot(spark, monkeypatch):
    """One id in a third of all rows: its slot is ranked in parts, and places stay gapless."""
    monkeypatch.setattr(sharding, "RANK_ROWS", 50)
    hot = spark.createDataFrame([(7 if i % 3 == 0 else i, f"text {i % 4}") for i in range(900)], "doc_id long, text string").repartition(5)
    rows = written(sharding.records(hot, n_slots=64), "r")
    m = sharding.SlotMap.initial(64, 4).measured(sharding.per_slot(rows))
    got = sharding.placed(rows, m).collect()
    assert len(got) == 900 and len({(r.vslot, r.part) for r in got if r.doc_id == 7}) > 3
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_slot_map(spark):
    rng = np.random.default_rng(3)
    sizes = {s: (int(b), 1) for s, b in enumerate(rng.lognormal(8, 1, 4096))}
    m = sharding.SlotMap.initial().measured(sizes)
    after = m.rebalanced()
    load = after.loads(16)
    assert sum(load) == sum(m.loads(16)) and max(load) - min(load) < 0.001 * max(load)
    assert sum(a != b for a, b in zip(m.shard, after.shard, strict=True)) < 1500  # an edit, not a new deal
    grown = after.grown(16)
    moved = [(a, b) for a, b in zip(after.shard, grown.shard, strict=True) if a != b]
    assert {b for _, b in moved} == {16} and len(moved) == 4096 // 17
    path = new_path(spark, "map")
    for x in (m, after, grown):
        sharding.save_map(spark, x, path)
    assert sharding.load_map(spark, path) == grown and sharding.load_map(spark, path, 1) == after


def test_language(docs):
    learned = language.learn(docs)
    got = {(r.doc_id, r.text): r for r in language.predict(docs, learned, keep=("text",)).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {(3, None), (4, ""), (5, "123 !!")}
    assert got[(6, "the quick brown fox " * 400)].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    none = language.predict(docs, {}).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]
    assert language.predict(docs.limit(0), learned).count() == 0 and language.prototypes(docs.limit(0)) == {}


def test_triples_of_long_texts_in_pieces(monkeypatch):
    texts = ["Der schnelle; braune Fuchs!", "a", "", "über das Feld"]
    def count():
        return sorted((int(o), int(k)) for own, keys in language.triples(texts) for o, k in zip(own, keys, strict=True))
    whole = count()
    monkeypatch.setattr(language, "PIECE", 4)
    assert count() == whole
    assert len(whole) == sum(c.isalpha() for t in texts for c in t)


@pytest.mark.parametrize("n", [64, 128, 160, 192, 1024, 32768, 32832, 100032])
def test_media_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    stream = media.mux_bytes(payload)
    got = media.demux_bytes(stream)
    assert got["valid"] and got["payload"] == payload and len(got["pts"]) == len(got["random_access"]) == -(-n // 32768)
    assert got["pts"] == [k * media.UNIT_TICKS for k in range(len(got["pts"]))]
    lost = stream[: 188 * 3] + stream[188 * 4 :] if n > 400 else stream[:-5]
    assert not media.demux_bytes(lost)["valid"]
    twice = stream[: 188 * 3] + stream[188 * 2 :]
    assert media.demux_bytes(twice)["payload"] == payload
    assert media.demux_bytes(b"")["valid"] is False and media.demux_bytes(b"\0" * 188)["valid"] is False


def test_media_of_other_writers():
    """Two programs, tables in several sections, a flagged discontinuity, a damaged table."""
    def packet(pid, counter, body, start=False, flags=None):
        head = bytes([0x47, 0x40 * start | pid >> 8, pid & 0xFF, 0x10 | 0x20 * (flags is not None) | counter & 15])
        room = 184 - len(body)
        field = b"" if flags is None else bytes([room - 1, flags]) + b"\xff" * (room - 2)
        return (head + field + body).ljust(188, b"\xff")

    def table(table_id, number, programs, at=0, last=0):
        body = bytes([table_id, 0xB0, len(programs) + 9]) + number.to_bytes(2, "big") + bytes([0xC1, at, last]) + programs
        return b"\0" + media._section(body)

    def entry(a, b):
        return a.to_bytes(2, "big") + (0xE000 | b).to_bytes(2, "big")

    def pmt(*streams):
        return (0xE000 | streams[0][1]).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([k]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\0" for k, p in streams)

    def pes(data):
        return b"\x00\x00\x01\xbd" + (len(data) + 3).to_bytes(2, "big") + b"\x84\0\0" + data

    tables = [
        packet(0, 0, table(0, 1, entry(1, 0x100), 0, 1), True), packet(0, 1, table(0, 1, entry(2, 0x101), 1, 1), True),
        packet(0x100, 0, table(2, 1, pmt((6, 0x200), (6, 0x201))), True), packet(0x101, 0, table(2, 2, pmt((6, 0x202))), True),
    ]
    units = [packet(0x200, 3, pes(b"one"), True, 0x40), packet(0x201, 0, pes(b"two"), True, 0), packet(0x202, 5, pes(b"three"), True, 0), packet(0x200, 9, pes(b"four"), True, 0x80)]
    got = list(media.demux_streams(b"".join(tables + units)))
    assert [(g["stream"], g["es_pid"], g["payload"], g["valid"]) for g in got] == [(0, 0x200, b"onefour", True), (1, 0x201, b"two", True), (2, 0x202, b"three", True)]
    assert media.demux_bytes(b"".join(tables + units)) == got[0]
    units[3] = packet(0x200, 9, pes(b"four"), True, 0)  # the same jump, not flagged
    assert [g["valid"] for g in media.demux_streams(b"".join(tables + units))] == [False, True, True]
    broken = packet(0x100, 0, b"\0\x02\xb0\x05\0\x01\xc1" + media.crc32_mpeg(b"\x02\xb0\x05\0\x01\xc1").to_bytes(4, "big"), True)
    assert [g["es_pid"] for g in media.demux_streams(b"".join([tables[0], broken, *units]))] == [None]


def test_media_rows(docs):
    got = media.demux(media.mux(docs.select("doc_id", F.encode("text", "UTF-8").alias("bytes")))).collect()
    assert len(got) == len(TEXTS) and all(r.valid and len(r.payload) % 64 == 0 for r in got)
    assert {bytes(r.payload).rstrip(b"\0") for r in got} == {(t or "").encode() for _, t, *_ in TEXTS}


def test_tokens_equal_the_library():
    e = tokens.Encoder()
    for text in [t or "" for _, t, *_ in TEXTS] + ["It's we'll -'s ''re ' d'été ÀÉÎ ªº µ ½²³ 12 a_b", "\x1c\x85\xa0 x"] + [f"ab{chr(c)}cd {chr(c)}'S" for c in range(0x20, 0x180)]:
        assert e.ids(text) == np.array(e.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing(docs):
    rows = packing.pack(docs).collect()
    e = tokens.Encoder()
    want = sorted(len(e.ids(t or "")) // 4 + 1 for _, t, *_ in TEXTS)
    assert sum(r.length for r in rows) == sum(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
    one = [r for r in rows if r.doc_id == 3]
    assert [(r.start, r.length, r.doc_tokens, r.ids_crc32) for r in one] == [(0, 1, 1, zlib.crc32(packing.END))]
    assert packing.pack(docs.limit(0)).count() == 0


def test_sum_of_squares_choice_and_drain():
    rng = np.random.default_rng(1)
    p = packing.SumOfSquares(20)
    for _ in range(300):
        size = int(rng.integers(1, 20))
        n = p.count.copy()

        def after(level, n=n, size=size):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 20:
                m[level + size] += 1
            return int((m[1:20] ** 2).sum())

        options = [h for h in range(1, 21 - size) if n[h]] + [0]
        chosen = p.level_for(size)
        assert after(chosen) == min(after(h) for h in options)
        p.place((0, 0, b"\1\0\0\0" * size, size), size)
    left = list(p.drain())
    assert all(sum(len(x[2]) // 4 for x in w) == 20 for w in left[:-1])


@pytest.mark.parametrize("window,grain", [(64, 8), (64, 1), (4096, 128)])
def test_packing_with_coarse_levels(window, grain):
    """Every choice is one that keeps the squared counts of levels smallest; each id lies in one piece; placement closes most windows."""
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in np.minimum(rng.lognormal(np.log(window / 5), 1.2, 3000) + 1, 3 * window)]
    p = packing.SumOfSquares(window, grain)
    for size in sizes[:400]:
        size = min(size, window - 1)

        def after(level, size=size):
            m = p.count.copy()
            if level:
                m[level] -= 1
            to = -(-((p.fill[level] if level else 0) + size) // grain)
            if to < p.top:
                m[to] += 1
            return int((m**2).sum())

        options = [h for h in range(1, p.top) if p.count[h] and p.fill[h] + size <= window] + [0]
        assert after(p.level_for(size)) == min(after(h) for h in options)
        p.place((0, 0, bytes(4 * size), size), size)
        assert all(p.count[h] == len(p.open[h]) and all(-(-f // grain) == h for f, _ in p.open[h]) for h in range(1, p.top))
    docs = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(sizes)]
    windows = list(packing.pack_stream(iter(docs), window, grain))
    spans = {}
    for k, (held, _) in enumerate(windows):
        assert sum(len(x[2]) // 4 for x in held) == window or k == len(windows) - 1
        for doc, start, ids, total in held:
            assert total == sizes[doc] and ids == docs[doc][1][4 * start : 4 * start + len(ids)]
            spans.setdefault(doc, []).append((start, len(ids) // 4))
    for doc, n in enumerate(sizes):
        at = 0
        for start, length in sorted(spans[doc]):
            assert start == at and length > 0
            at += length
        assert at == n
    placed = sum(len(x[2]) // 4 for held, done in windows if done for x in held) / sum(sizes)
    assert placed > (0.97 if grain > 1 else 0.5)


def test_fingerprints(spark):
    rng = np.random.default_rng(2)
    texts = {i: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(0, 400))) for i in range(60)} | {60: None, 61: "", 62: "ab"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprints.compared(fingerprints.by_id_ranges(rows, 8)).collect()}
    assert sorted(got) == sorted(texts)
    h, ids = fingerprints.Hasher(), sorted(texts)
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(text)
        shingles = {text[j : j + 10] for j in range(max(1, len(text) - 9))} - {""}
        every = {int(h.hashes(fingerprints.code_points(s))[0]) for s in shingles}
        below = sorted(x for x in every if x < fingerprints.LIMIT) or sorted(every)[:1]
        assert fingerprints.read(got[i].fingerprint).tolist() == below
    a, b = h.sketch(fingerprints.code_points("x" * 50 + texts[5] * 9)), h.sketch(fingerprints.code_points(texts[5] * 9))
    assert fingerprints.containment(b, a) > 0.9 and fingerprints.merged(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
    assert fingerprints.compared(fingerprints.by_id_ranges(rows.limit(0), 4)).count() == 0
    alone = fingerprints.compared(fingerprints.by_id_ranges(rows.where("doc_id = 5"), 4)).first()
    assert alone.near_next == 1.0
    odd = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n")], "doc_id long, text string")
    assert fingerprints.compared(fingerprints.by_id_ranges(odd, 3)).count() == 3
    # one id, and no id, in a third of all rows each: still each row once, with a successor in (id, hash) order
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"text number {i % 50} " * 3) for i in range(300)]
    hot = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = sorted(((r.doc_id is None, r.doc_id or 0, r.h, r.text) for r in hot.collect()))
    h, want = fingerprints.Hasher(), []
    for k, (none, i, _, text) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        s, e, n = (h.sketch(fingerprints.code_points(x)) for x in (text, new, after))
        want.append((None if none else i, hashlib.sha256(new.encode()).hexdigest(), fingerprints.spelled(e), fingerprints.likeness(s, e), fingerprints.likeness(s, n)))
    dealt = fingerprints.by_id_ranges(hot.select("doc_id", "text"), 12)
    assert dealt.where("doc_id = 5 AND NOT guest").select("part").distinct().count() > 1
    got = [(r.doc_id, r.edited_sha256, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.compared(dealt).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # two thousand rows that are equal, without an id and without a text, among others: cut into several ranges, each row once
    same = spark.createDataFrame([(None, None)] * 2000 + [(i, f"text {i} " * 9) for i in range(100)], "doc_id long, text string").repartition(6)
    dealt = fingerprints.by_id_ranges(same, 12).cache()
    assert dealt.where("doc_id IS NULL AND NOT guest").select("part").distinct().count() > 3
    assert dealt.where("guest").count() <= 12 * 6 and dealt.where("NOT guest").count() == 2100
    got = fingerprints.compared(dealt).collect()
    empty = [r for r in got if r.doc_id is None]
    assert len(empty) == 2000 and sorted(r.near_next for r in empty)[:2] == [0.0, 1.0]  # the last of them is followed by the first row of all
    assert len({r.doc_id for r in got}) == 101 and len(fingerprints.by_id_ranges(same, 12)._jdf.queryExecution().optimizedPlan().toString()) < 4000
    lone = np.array([fingerprints.LIMIT + 5], np.uint64)
    assert fingerprints.containment(lone, np.array([1, 2], np.uint64)) is None and fingerprints.containment(lone, lone) == 1


def test_mixing(spark, docs, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{min(9, int(rng.integers(0, 30)))}" if i % 50 else None) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    p = mixing.plan(d)
    got = mixing.drawn(d, p).collect()
    assert len(got) == 1500 and sum(len(x.text.split()) for x in mixing.mixed(d, p).collect()) == sum(w.words for r in got for w in r.draws)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(t.split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, mixing.targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes)), strict=True))
    assert abs(sum(want.values()) - 1.5 * sum(sizes)) < 1e-6 and all(t <= 2 * s + 1e-9 for t, s in zip(want.values(), sizes, strict=True))
    for n in names:
        mine = [r for r in got if r.source == n]
        taken = sum(w.words for r in mine for w in r.draws)
        assert abs(taken - want[n]) <= 1 and all(r.target == want[n] for r in mine)
    assert all(sum(w.words for w in r.draws) <= 2 * r["size"] for r in got)
    again = mixing.drawn(d.repartition(3), mixing.plan(d.repartition(3)))
    assert {(r.doc_id, str(r.draws)) for r in again.collect()} == {(r.doc_id, str(r.draws)) for r in got}
    monkeypatch.setattr(mixing, "CUT_ROWS", 4)  # the same cut, found in several steps
    monkeypatch.setattr(mixing, "STEP_BITS", 3)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    wide = mixing.drawn(d, mixing.plan(d))
    monkeypatch.setattr(mixing, "CUT_ROWS", 4096)
    assert {(r.doc_id, str(r.draws)) for r in wide.collect()} == {(r.doc_id, str(r.draws)) for r in mixing.drawn(d, mixing.plan(d)).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(mixing, "SHARD_BYTES", 5000)
    many = mixing.plan(d, shards=None)
    out = mixing.mixed(d, many).withColumn("task", F.spark_partition_id())
    size, tasks = {}, {}
    for r in out.collect():
        size[r.shard] = size.get(r.shard, 0) + 1
        tasks.setdefault(r.shard, set()).add(r.task)
    assert len(size) > 20 and all(t == {s} for s, t in tasks.items()) and max(size.values()) < 3 * min(size.values()) + 60
    odd = mixing.drawn(docs.select("doc_id", "text", "source"), mixing.plan(docs.select("doc_id", "text", "source"))).collect()
    assert len(odd) == len(TEXTS) and {r["size"] for r in odd} == {len(WORD.findall(t or "")) for _, t, *_ in TEXTS}
    named = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("draw_at", "mix_draw", "plan_blocks", "mix0", "target", "name", "a.b"))])
    clash = mixing.mixed(named, mixing.plan(named))  # has columns named size and score
    assert clash.columns == [*named.columns, "shard"]
    assert {(r["size"], r.score, r.draw_at, r.mix_draw, r.plan_blocks, r.mix0, r.target, r.name, r["a.b"]) for r in clash.collect()} == {(1, "x", 0, 1, 2, 3, 4, 5, 6)}
    assert mixing.drawn(named, mixing.plan(named)).select("target").first()[0] != 4
    empty = docs.select("doc_id", "text", "source").limit(0)
    assert mixing.drawn(empty, mixing.plan(empty)).count() == 0


def test_split_quotas():
    q = np.array([1000, 0, 37, 5])
    got = mixing.split_quotas(q, 7)
    assert (got.sum(axis=0) == q).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1 and (got >= 0).all()
    assert (mixing.split_quotas(q, 7) == got).all()


def lm_losses(train: list[tuple[str, bool]], text: str) -> list[float]:
    """Mean loss of a text by a plain reading of the models: background first."""
    lead, out = bytes(4), []
    seen = [(lead + t.encode(), good) for t, good in train]
    n = [sum(len(b) - 4 for b, good in seen if good == bool(side)) for side in (0, 1)]
    for side in (0, 1):
        count, context = {}, {}
        for b, good in seen:
            for k in range(4, len(b)):
                for m in range(1, 6):
                    if good == bool(side):
                        g = b[k - m + 1 : k + 1]
                        count[g] = count.get(g, 0) + 1
                        context[g[:-1], m] = context.get((g[:-1], m), 0) + 1
        scale, b, loss = 1.0 if side else n[1] / max(1, n[0]), lead + text.encode(), 0.0
        for k in range(4, len(b)):
            p = 1 / 256
            for m in range(1, 6):
                g = b[k - m + 1 : k + 1]
                p = (scale * count.get(g, 0) + lmscore.PRIOR * p) / (scale * context.get((g[:-1], m), 0) + lmscore.PRIOR)
            loss -= np.log(p) / (len(b) - 4)
        out.append(loss)
    return out


def test_copies_are_not_trained_on(spark):
    """Copies of a text under other ids are in its fold, so however many there are, its scores are those of one."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "five", "six"], 30)) for _ in range(40)]
    odd = "a text of which there are copies, and no other like it"
    target = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    made = {}
    for n in (1, 30):
        rows = spark.createDataFrame([*enumerate(texts), *((100 + i, odd) for i in range(n))], "doc_id long, text string").repartition(3)
        found = lmscore.scored_out_of_fold(rows, target).where("doc_id >= 100").collect()
        assert len(found) == n and len({(r.target_loss, r.background_loss) for r in found}) == 1
        made[n] = (found[0].target_loss, found[0].background_loss)
    assert made[1] == made[30]


def test_lm_scores(spark, docs, monkeypatch):
    """Out of fold, on new texts with unseen n-grams, and by parts of any size, against a plain reading."""
    target = spark.createDataFrame([(1,), (6,), (6,), (None,)], "doc_id long")
    fold = {(r.doc_id, r.text): r.part % lmscore.VIEWS for r in lmscore.placed(docs)[0].collect()}
    got = lmscore.scored_out_of_fold(docs, target).collect()
    assert len(got) == len(TEXTS) and len(set(fold.values())) > 1
    for i, text, *_ in TEXTS:
        rows = [r for r in got if r.doc_id == i]
        train = [(t or "", j in (1, 6)) for j, t, *_ in TEXTS if fold[j, t] != fold[i, text]]
        if not text:
            assert [(r.n_tokens, r.target_loss, r.score) for r in rows] == [(0, None, None)]
            continue
        want = lm_losses(train, text)
        assert all(r.n_tokens == len(text.encode()) and abs(r.background_loss - want[0]) < 1e-9 and abs(r.target_loss - want[1]) < 1e-9 for r in rows)
    counts = lmscore.trained(docs, target)
    new = [(1, "hello zorro"), (2, "aaaa"), (3, "the quick brown dog"), (4, ""), (5, "日本 fox")]
    fresh = spark.createDataFrame(new, "doc_id long, text string")
    scored = {r.doc_id: r for r in lmscore.scored(fresh, counts).collect()}
    for i, text in new:
        want = lm_losses([(t or "", j in (1, 6)) for j, t, *_ in TEXTS], text) if text else None
        assert scored[i].score is None if not text else abs(scored[i].score - (want[1] - want[0])) < 1e-9
    empty = lmscore.trained(docs.limit(0), target)
    assert {r.score for r in lmscore.scored(fresh, empty).collect()} == {0.0, None}
    assert lmscore.scored(fresh.limit(0), counts).count() == 0
    nobody = lmscore.scored_out_of_fold(docs, target.limit(0)).collect()
    assert {r.score for r in nobody} == {0.0, None}
    whole = sorted(map(str, lmscore.scored_out_of_fold(docs, target).collect()))
    monkeypatch.setattr(lmscore, "PART_BYTES", 200)
    monkeypatch.setattr(lmscore, "HELD_GRAMS", 50)
    monkeypatch.setattr(lmscore, "PIECE", 64)
    close = sorted(map(str, lmscore.scored_out_of_fold(docs, target).select("doc_id", "n_tokens").collect()))
    assert close == sorted(map(str, spark.createDataFrame([(r.doc_id, r.n_tokens) for r in got], "doc_id long, n_tokens long").collect())) and len(whole) == len(got)


def test_zip_reader_on_other_writers(tmp_path):
    for zip64 in (False, True):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
            with z.open("archive/a.bin", "w", force_zip64=zip64) as f:
                f.write(b"payload" * 100)
            z.writestr("indexes/i", b"index" * 50, zipfile.ZIP_DEFLATED)
            z.comment = b"a comment"
        f = io.BytesIO(buffer.getvalue())
        found = webarchive.members(f, len(buffer.getvalue()))
        assert set(found) == {"archive/a.bin", "indexes/i"} and webarchive.whole_member(f, found["indexes/i"]) == b"index" * 50
        assert webarchive.whole_member(f, found["archive/a.bin"]) == b"payload" * 100
    with pytest.raises(ValueError):
        webarchive.members(io.BytesIO(b"no zip"), 6)


def test_archives_of_other_writers(spark, tmp_path):
    """Gzipped indexes with header lines are read; what cannot be read is a row that says so."""
    import gzip as gz
    import json

    made = [webarchive.record(i, f"http://x/{i}", b"<p>%d" % i, hashlib.sha256(b"<p>%d" % i).hexdigest(), None, False)[0] for i in range(3)]
    made[1] = made[1][:-9] + b"\0" * 9  # damaged
    lines, at = ["!meta {\"format\": \"cdxj\"}", "no json"], 0
    for m in made:
        lines.append("x 2020 " + json.dumps({"offset": str(at), "length": str(len(m)), "filename": "data.warc.gz"}))
        at += len(m)
    index = gz.compress("\n".join(lines).encode())
    for name, kind in (("good", zipfile.ZIP_STORED), ("deflated", zipfile.ZIP_DEFLATED)):
        with zipfile.ZipFile(tmp_path / name, "w", kind) as z:
            z.writestr("archive/data.warc.gz", b"".join(made))
            z.writestr("indexes/index.cdx.gz", index, zipfile.ZIP_STORED)
    with zipfile.ZipFile(tmp_path / "bare", "w") as z:
        z.writestr("archive/data.warc.gz", made[0])
    (tmp_path / "cut").write_bytes((tmp_path / "good").read_bytes()[:-40])
    def read(name):
        manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string")
        return sorted(((r.page_id, r.record_type, r.intact) for r in webarchive.read_records(webarchive.locate(manifest)).collect()), key=str)
    assert read("good") == [(0, "response", True), (2, "response", True), (None, "unreadable", False)]
    assert read("deflated") == [(None, "unreadable", False)] * 3
    assert read("bare") == read("cut") == [(None, "unreadable", False)]


def test_archives(spark):
    html = [(1, "http://a/ b\r\nX: y", "<p>" + "ä" * 100), (2, None, "<p>" + "ä" * 100), (3, "http://c", "short"), (4, "http://d", "short"), (5, "u", None), (None, "u", "<p>" + "ä" * 100), (1, "again", "<p>" + "ä" * 100)]
    pages = spark.createDataFrame([(*h, 0) for h in html], "page_id long, url string, html string, payload int").repartition(2)
    uri = new_path(spark, "a")
    manifest = written(webarchive.write_archives(webarchive.with_roles(pages), uri, archive_bytes=300), "m")
    paths = [r.path for r in manifest.collect()]
    for path in paths:  # an independent reader agrees
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
    assert sum(r.records for r in manifest.collect()) == 7
    got = webarchive.read_records(webarchive.locate(manifest, span_bytes=1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, webarchive.read_records(webarchive.locate(manifest)).collect()))
    want = {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (None, "revisit", 1)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == want and all(r.intact for r in got)
    body = {i: (h or "").encode() for i, _, h in html}
    assert all(r.payload_bytes == len(body[r.page_id]) and r.payload_digest == hashlib.sha256(body[r.page_id]).hexdigest() for r in got)
    assert all(bytes(r.payload) == body[r.page_id] for r in got if r.record_type == "response")
    empty = written(webarchive.write_archives(webarchive.with_roles(pages.limit(0)), uri + "e"), "m")
    assert webarchive.read_records(webarchive.locate(empty)).count() == 0
