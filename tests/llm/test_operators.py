import collections
import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltra.llm import _textvec as tv
from voltra.llm import decontaminate, jaccard, licences, linededup, neighbours, packing, quality, sharding, toolchat, urlfilter

from . import helpers as H


# -- packing -----------------------------------------------------------------------------------------------------
def test_packing_matches_tokenizer_and_leaves_no_gap(spark):
    from tokenizers import Tokenizer

    docs = H.documents(spark)
    got = packing.pack(H.clashing(docs), keep_ids=False).toPandas()
    coder = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for r in docs.collect():
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[(r.doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) + 1
    assert packing.pack(H.empty(spark), keep_ids=False).count() == 0


def test_packing_keeps_ids_and_odd_text(spark):
    from tokenizers import Tokenizer

    texts = ["H̱ X, it's, DON'T. 12,5 a.b, ...,, x. \t\r\n <|endoftext|> Y<|endoftext|>Z, Éa, \x0b\x1c q ΑΣ, İx, ﬁ. A", ", . ,. .", "é, É. 9, 9. a, "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coder = Tokenizer.from_file(packing.default_tokenizer())
    for r in packing.pack(docs).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*coder.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]


def test_packing_of_special_tokens_null_ids_and_hot_rows(spark):
    from tokenizers import Tokenizer

    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "a <|endoftext|> b", "x", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "lone"), (None, None)] + [(7, "hot row")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    coder = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs.withColumns({c: F.lit(1) for c in ("row", "length", "rank")})).collect()
    want = collections.Counter((d, tuple([*coder.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert len({(r.sequence_id, r.offset) for r in got}) == len(rows) and len({r.sequence_id for r in got}) == 2


def _best_fit(sizes, seq_len):
    """How many sequences best-fit needs, one document after the other, the largest first."""
    free = []
    for s in sorted(sizes, reverse=True):
        at = min((f, i) for i, f in enumerate([*free, seq_len]) if f >= s)[1] if s else 0
        if at == len(free):
            free.append(seq_len)
        free[at] -= s
    return len(free)


def test_supersteps_place_every_document_once(spark):
    rng = random.Random(1)
    for most, n in ((100, 400), (100, 30), (12, 300), (1, 250), (100, 0)):
        counts = collections.Counter(rng.randrange(1, most + 1) for _ in range(n))
        fill, ranks = collections.Counter(), collections.defaultdict(list)
        rows = packing.supersteps(spark.createDataFrame(list(counts.items()), "length long, n long"), 100).collect()
        for size, first, m, sequence, offset, per in sorted(rows, key=lambda r: r.offset):
            for i in range(m):
                assert fill[sequence + i // per] == offset + size * (i % per)
                fill[sequence + i // per] += size
                ranks[size].append(first + i)
        assert all(sorted(ranks[s]) == list(range(m)) for s, m in counts.items()) and max(fill.values(), default=0) <= 100
        assert len(fill) <= _best_fit(counts.elements(), 100) * 1.02 + 1


# -- chat --------------------------------------------------------------------------------------------------------
def test_tool_calls(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes\n\"q\""), (1, 2, "user", ""), (1, 4, "user", "again"), (1, 5, "assistant", None), (2, 1, "assistant", "lone"), (2, 9, "system", "s"), (None, 1, "user", "x"), (3, 0, None, "x"), (1, 0, "user", "zz"), (4, 0, "user", None), (5, 0, "user", "w" * 700)]
    got = {r.call_id: r for r in toolchat.link(*toolchat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), toolchat.REPLY_SCHEMA).collect()}
    assert {k: (r.level, r.status, r.valid) for k, r in got.items()} == {"1-0": (0, "linked", True), "1-2": (1, "unanswered", False), "1-4": (2, "linked", True), "2-0": (None, "orphan", None), "4-0": (0, "unanswered", False), "5-0": (0, "unanswered", False)}
    assert got["1-0"].record == '{"arguments":{"prompt":"hi","turn":0},"id":"1-0","level":0,"name":"reply","result":"yes\\n\\"q\\"","status":"linked"}'
    assert toolchat.link(*toolchat.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), toolchat.REPLY_SCHEMA).count() == 0


def test_every_turn_of_a_chat_has_a_row(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 1, "user", "Hi"), (1, 3, "tool", "{}"), (1, 4, None, "?"), (None, 1, "user", "x"), (2, 0, "user", None), (2, 0, "user", "y"), (1, 0, "system", "be kind"), (3, 1, "assistant", None), (3, 1, "assistant", "z")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = toolchat.chat(docs).collect()
    want = toolchat.link(*toolchat.from_turns(docs), toolchat.REPLY_SCHEMA)
    assert sorted(map(repr, got)) == sorted(map(repr, [*want.collect(), *(r for r in got if r.call_id is None)]))
    texts, kinds = [], collections.Counter()
    for r in got:
        x = json.loads(r.record)
        if r.call_id is None:
            kinds[r.status] += 1
            texts.append((x["conversation"], x["turn"], x["role"], x["text"]))
        else:
            conv, t = map(int, r.call_id.split("-"))
            if r.status != "orphan":
                texts.append((conv, t, "user", x["arguments"].get("prompt")))
            if r.status != "unanswered":
                texts.append((conv, t + 1, "assistant", x["result"]))
    assert sorted(texts, key=repr) == sorted(set(rows), key=repr)
    assert kinds == {"turn": 3, "repeated": 4, "unplaced": 1}
    assert toolchat.chat(docs.limit(0)).count() == 0


def test_identifiers_belong_to_a_conversation(spark):
    calls = spark.createDataFrame([(1, 0, "c1", "reply", '{"prompt":"a","turn":0}', None), (2, 0, "c1", "reply", '{"prompt":"b","turn":0}', None), (None, 3, "c1", "reply", "{", None)], "conv_id long, turn long, call_id string, name string, arguments string, waits_for string")
    results = spark.createDataFrame([(1, 1, "c1", "x"), (2, 1, "c1", "y"), (3, 1, "c1", "z")], "conv_id long, turn long, call_id string, content string").withColumn("level", F.lit("extra"))
    got = {r.conv_id: (r.status, r.level, r.valid, json.loads(r.record)["result"]) for r in toolchat.link(calls.withColumn("k", F.lit(1)), results, toolchat.REPLY_SCHEMA).collect()}
    assert got == {1: ("linked", 0, True, "x"), 2: ("linked", 0, True, "y"), 3: ("orphan", None, None, "z"), None: ("unanswered", 0, False, None)}


def test_levels_of_calls_with_several_prerequisites(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for conv in (1, 2):
        for i in range(60):
            up = rng.sample(range(max(0, i - 8), i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))
            rows.append((conv, f"c{i}", [f"c{j}" for j in up] + ["gone"]))
            want[conv, f"c{i}"] = max((want[conv, f"c{j}"] + 1 for j in up), default=0)
    rows += [(3, "x", ["y", "z"]), (3, "y", ["x"]), (3, "z", []), (3, "w", ["x"]), (3, "v", None), (3, "s", ["s"])]
    want |= {(3, "x"): None, (3, "y"): None, (3, "z"): 0, (3, "w"): None, (3, "v"): 0, (3, "s"): None}
    got = toolchat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, waits_for array<string>")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want and len(got) == len(want)


def test_levels_of_long_chains_and_cycles(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r.call_id: r.level for r in toolchat.levels(spark.createDataFrame([(1, *r) for r in rows], "conv_id long, call_id string, waits_for string")).collect()}
    assert all(got[f"c{i}"] == i for i in range(40)) and got["z"] == 0 and got["x"] is None and got["y"] is None
    assert toolchat.violations({"a": 1, "b": [True]}, {"properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "integer"}}}, "required": ["c"]}) == ["$.c: missing", "$.a: not string", "$.b[0]: not integer"]


# -- near duplicates ---------------------------------------------------------------------------------------------
def _links(docs):
    rows = [(i, r.doc_id, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := H.words(r.text)) else set()) for i, r in enumerate(docs.collect())]
    n, up = collections.Counter(), {i: i for i, *_ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, _, a in rows:
        for j, _, b in rows[:i]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                n[i] += 1
                n[j] += 1
                up[top(i)] = top(j)
    low = {}
    for i, d, _ in rows:
        low[top(i)] = min(d, low.get(top(i), d))
    return sorted((d, low[top(i)], n[i]) for i, d, _ in rows)


def test_jaccard_join_against_brute_force(spark):
    docs = H.documents(spark)
    base = docs.filter("doc_id = 20").first().text.split()
    near = spark.createDataFrame([(500 + i, " ".join([*base[:i], "odd", *base[i + 1 :]]) + f" tail{i}", "en", "hot", 0) for i in range(25)], H.SCHEMA)
    docs = docs.union(near)
    assert sorted(map(tuple, jaccard.join(H.clashing(docs)).collect())) == _links(docs)
    assert jaccard.join(H.empty(spark)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and 5 not in {r.doc_id for r in kept.collect()}


def test_jaccard_join_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 3)
    rng = random.Random(2)
    base = H.sentence(rng, 80).split()
    rows = []
    for i in range(30):
        w = list(base)
        w[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    docs = spark.createDataFrame(rows, H.SCHEMA)
    assert sorted(map(tuple, jaccard.join(docs).collect())) == _links(docs)


def test_forests_of_exact_links_join_the_same_sets():
    rng = np.random.RandomState(15)
    for _ in range(30):
        base = [set(rng.choice(60, 12)) for _ in range(3)]
        sets = [(base[rng.randint(3)] ^ set(rng.choice(60, rng.randint(3)))) or {1} for _ in range(25)]
        owner, code = np.repeat(np.arange(25), [len(x) for x in sets]), np.concatenate([sorted(x) for x in sets])
        up = list(range(25))
        for i in range(25):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    up = [up[j] if u == up[i] else u for u in up]
        mine = list(range(25))
        for i, j in jaccard._tree(owner, code, np.array([len(x) for x in sets]), 0.8):
            assert mine[i] != mine[j]
            mine = [mine[j] if u == mine[i] else u for u in mine]
        assert all((up[i] == up[j]) == (mine[i] == mine[j]) for i in range(25) for j in range(25))


# -- repeated passages -------------------------------------------------------------------------------------------
def _cut_by_hand(docs, least=20, radius=4):
    """(doc_id, text, spans) of each row: lines cut into pieces one word at a time, and digests that are the words."""
    rows, units = [(r.doc_id, r.text) for r in docs.collect()], []
    for _, text in rows:
        mine, word, at = [], 0, 0
        for line in (text or "").split("\n"):
            w = list(H.WORD.finditer(line.translate({i: i + 32 for i in range(65, 91)})))
            h = [int(tv.words(np.frombuffer(x[0].encode(), np.uint8), np.array([0, len(x[0].encode())]))[0][0]) for x in w]
            starts = [0] + [i for i in range(radius, len(w) - radius) if h[i] < min(h[i - radius : i] + h[i + 1 : i + 1 + radius])] if w else []
            for i, j in zip(starts, [*starts[1:], len(w)][: len(starts)], strict=True):
                a, z = (0 if i == 0 else w[i].start()), (len(line) if j == len(w) else w[j].start())
                mine.append((tuple(x[0] for x in w[i:j]), word + i, j - i, at + a, at + z))
            word, at = word + len(w), at + len(line) + 1
        units.append(mine)
    low = {}
    for (d, _), mine in zip(rows, units, strict=True):
        for u in mine:
            low[u[0]] = min(low.get(u[0], (True, 0)), (d is None, d or 0))
    out = []
    for (d, text), mine in zip(rows, units, strict=True):
        seen, runs = set(), []
        for key, word, n, a, z in mine:
            if (d is None, d or 0) > low[key] or key in seen:
                if runs and runs[-1][0] + runs[-1][1] == word:
                    runs[-1] = (runs[-1][0], runs[-1][1] + n, runs[-1][2], z)
                else:
                    runs.append((word, n, a, z))
            seen.add(key)
        spans, kept, done = [], "", 0
        for _, n, a, z in runs:
            if n >= least:
                z += (a == 0 or text[a - 1] == "\n") and text[z : z + 1] == "\n"
                spans.append((a, z))
                kept, done = kept + text[done:a], z
        out.append((d, text if text is None else kept + text[done:], spans))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    common, passage = H.sentence(rng, 27), ". ".join(H.sentence(rng, 12) for _ in range(5))
    rows = [(i, "\n".join([H.sentence(rng, 9), common, f"{H.sentence(rng, 5)} {i}. {passage}. {H.sentence(rng, 4)}", "x y"]), "en", "s", 0) for i in range(12)]
    lines = [H.sentence(rng, n) for n in (9, 1, 8, 30, 2, 40)]
    rows += [(40 + i, "\n".join([H.sentence(rng, 3), *lines[: i + 1], "", *lines[: i + 1]]), "en", "s", 0) for i in range(6)]
    rows += [(None, common + "\n" + H.sentence(rng, 3), "", "", 0), (3, common + "\nother", "", "", 0), rows[4]]
    docs = spark.createDataFrame(rows, H.SCHEMA).union(H.documents(spark).withColumn("doc_id", F.col("doc_id") + 100))
    got = linededup.dedup(H.clashing(docs).withColumns({c: F.lit(0) for c in ("cut", "CUT_ID", "cut_th", "th", "text_", "_cut_id", "_cut_hash")})).collect()
    assert sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.cut_spans]) for r in got), key=repr) == _cut_by_hand(docs)
    out, texts = {r.doc_id: r.text for r in got}, {r.doc_id: r.text for r in docs.collect()}
    assert out[0] == texts[0]
    assert all(common not in out[i] and not any(s in out[i] for s in passage.split(". ")[1:-1]) for i in range(1, 12) if i != 3)
    assert all(out[i].startswith(texts[i].split("\n")[0]) and out[i].endswith("x y") for i in range(12) if i != 3)
    assert len(got) == docs.count() and linededup.clean(docs).schema == docs.schema and linededup.dedup(H.empty(spark)).count() == 0


def test_short_phrases_and_notices_stay(spark):
    rng = random.Random(13)
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(i, f"{H.sentence(rng, 30)}\n{notice}\n{H.sentence(rng, 5)}", "en", "s", 0) for i in range(30)]
    assert all(r.text == rows[r.doc_id][1] for r in linededup.dedup(spark.createDataFrame(rows, H.SCHEMA)).collect())


def test_passages_without_stops_are_cut_wherever_they_stand(spark):
    rng = random.Random(8)
    passages = [H.sentence(rng, 51) for _ in range(30)]
    rows = [(i, f"{H.sentence(rng, rng.randrange(1, 40))} {passages[i % 30]} {H.sentence(rng, rng.randrange(1, 40))}", "en", "s", 0) for i in range(120)]
    out = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, H.SCHEMA)).collect()}
    assert all(out[i] == rows[i][1] for i in range(30))
    assert not [i for i in range(30, 120) if passages[i % 30] in out[i]]
    for i in range(30, 120):  # the words around a passage stay
        before, after = rows[i][1].split(passages[i % 30])
        assert out[i].startswith(before.rstrip()) and out[i].endswith(after.lstrip())


def test_passages_of_short_sentences_and_at_sentence_ends_are_cut(spark):
    rng = random.Random(9)
    short = [". ".join(H.sentence(rng, 5) for _ in range(12)) for _ in range(20)]
    ends = [f"{H.sentence(rng, 22)}. {H.sentence(rng, 22)}" for _ in range(20)]  # <= 25 words a sentence
    rows = [(i, f"{H.sentence(rng, 8)}. {short[i]}. {H.sentence(rng, 9)}\n{H.sentence(rng, 8)}. {ends[i]}. {H.sentence(rng, 7)}", "en", "s", 0) for i in range(20)]
    rows += [(i + 100, f"{H.sentence(rng, 8)} {short[i]} {H.sentence(rng, 9)}\n{H.sentence(rng, 30)} {ends[i]} {H.sentence(rng, 30)}", "en", "s", 0) for i in range(20)]
    out = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, H.SCHEMA)).collect()}
    assert all(out[i] == rows[i][1] for i in range(20))
    left = [[len(set(out[i + 100].split()) & set(p[i].replace(".", "").split())) for i in range(20)] for p in (short, ends)]
    assert max(left[0]) < 50 and np.mean(left[0]) < 30 and max(left[1]) < 42 and np.mean(left[1]) < 27


def test_a_sentence_after_signs_is_not_its_own_repeat(spark):
    text = "... one two three four five six seven"
    assert linededup.dedup(spark.createDataFrame([(1, text, "en", "s", 0)], H.SCHEMA)).first().text == text


# -- sharding ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("hot", [False, True])
def test_sharding_is_exact(spark, hot):
    docs = H.documents(spark, n=200)
    if hot:
        docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, 7).otherwise(F.col("doc_id"))).union(spark.createDataFrame([(None, "n", "", "", 1), (-(2**63), "m", "", "", 1), (2**63 - 1, "o", "", "", 1)], H.SCHEMA))
    rows = sharding.shard(H.clashing(docs))
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows.collect()) == want
    got = rows.toPandas()
    assert len(got) == docs.count()
    total = got["size"].sum()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got.shard) <= set(range(24))
    for s in range(1, 24):
        assert abs(got["size"][got.shard < s].sum() - total * s / 24) <= got["size"].max()
    assert sharding.shard(H.empty(spark)).count() == 0 and sharding.shard(docs.limit(1)).count() == 1


def test_a_group_of_equal_texts_fills_the_shards_its_bytes_need(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = sharding.shard(docs).toPandas()
    group = got[got.text_crc32 == zlib.crc32(b"the same text")]
    assert len(group) == 300 and sorted(group.doc_id) == list(range(0, 900, 3)) and group.shard.nunique() == 24
    assert got.sort_values("doc_id").shard.is_monotonic_increasing  # a row lies where its id lies


# -- licences ----------------------------------------------------------------------------------------------------
def _scan_by_hand(docs):
    """The rows of the scan: n-grams of each line and wrapped paragraph weighed one after the other."""
    import re

    classes, weights, intercepts = licences.model()
    templates = licences.marks()[1]

    def judge(text):
        w = licences.words(text)
        two = set(licences.bigrams(w))
        z = np.array(intercepts)
        for g in {*w, *two} & weights.keys():
            z = z + np.array(weights[g])
        c = max(range(len(classes)), key=lambda i: (z[i], classes[i]))
        like = max((len(two & t) / max(1, min(len(w) + 1, len(t))) for f, t in templates if f == classes[c]), default=0.0)
        return len(w), classes[c], 1 / np.exp(z - z[c]).sum(), like

    out = []
    for r in docs.collect():
        blocks = []
        for line in (r.text or "").split("\n") if r.text is not None else []:
            if blocks and line[:1].strip() and re.search(r"[^.!?:;\s][ \t\r]*$", blocks[-1][-1]):
                blocks[-1].append(line)
            else:
                blocks.append([line])
        for p, lines in enumerate(blocks):
            told = False
            for j, x in enumerate([*lines, " ".join(lines)] if len(lines) > 1 else lines):
                n, c, share, like = judge(x)
                term, likely = any(t in x.lower() for t in licences.KEY_TERMS), c != "unknown" and share >= 0.5
                family = c if likely and like >= 0.6 else "unknown"
                whole = j == len(lines)
                if (term or likely and like > 0) and not (whole and (told or family == "unknown")):
                    out.append((r.doc_id, p, None if whole else j, n, family, round(share, 4), round(like, 4)))
                told |= family != "unknown"
    return sorted(out, key=repr)


def test_licence_scan(spark):
    lines = {1: "Licensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0.", 5: "Copyright 2020 Foo Inc. All rights reserved.", 6: "A fishing license is sold at the harbour", 7: "licensed", 8: "plain text.\nReleased under the BSD License"}
    wrapped = "x y.\nPermission to use, copy,\nmodify, and distribute\nthis software for any\npurpose with or without\nfee is hereby granted."
    rng = random.Random(14)
    more = [(20 + i, " ".join(rng.choices([w for s in licences.TEMPLATES.values() for x in s for w in licences.words(x)] + ["\n", ". \n", "zzz"], k=rng.randrange(1, 60)))) for i in range(60)]
    docs = spark.createDataFrame([*lines.items(), (9, None), (10, ""), (11, wrapped), (12, lines[1] + "\n" + H.sentence(rng, 4000) + "\n\n" + lines[2]), (None, lines[2]), (1, lines[1]), *more], "doc_id long, text string").withColumns({"line": F.lit("x"), "w": F.lit(1), "rid": F.lit(2), "n": F.lit(3)})
    rows = licences.scan(docs).collect()
    got = {r.doc_id: (r.family, r.paragraph, r.line) for r in rows if r.doc_id in lines}
    assert got == {1: ("apache", 0, 0), 2: ("mit", 0, 0), 3: ("gpl", 0, 0), 4: ("cc-by-nc", 0, 0), 5: ("proprietary", 0, 0), 6: ("unknown", 0, 0), 7: ("unknown", 0, 0), 8: ("bsd", 1, 0)}
    assert [(r.family, r.paragraph) for r in rows if r.doc_id == 11 and r.line is None] == [("isc", 1)] or any(r.doc_id == 11 and r.family == "isc" for r in rows)
    assert sorted(((r.doc_id, r.paragraph, r.line, r.n_words, r.family, round(r.probability, 4), round(r.resemblance, 4)) for r in rows), key=repr) == _scan_by_hand(docs)
    assert licences.scan(docs.limit(0)).count() == 0
    plan = licences.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_without_key_terms_have_rows(spark):
    lines = ["Distributed under the terms of the GNU GPL, version 3", "Released under MIT", "Available under CC-BY-NC 4.0", "Apache-2.0", "Sie kam mit der Bahn in die Stadt", "the end of the day", "", "x", "MPL 2.0", "GPLv3", "SPDX-License-Identifier: MIT"]
    got = {r.doc_id: r.family for r in licences.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {0: "gpl", 1: "mit", 2: "cc-by-nc", 3: "apache", 8: "mpl", 9: "gpl", 10: "mit"}


def test_licence_model_on_notices_it_has_not_seen():
    classes, weights, intercepts = licences.model()
    right, sure, n = 0, 0.0, 0
    for c, w in licences._perturbed(random.Random(99), 4):
        z = np.array(intercepts) + sum((np.array(weights[g]) for g in {*w, *licences.bigrams(w)} & weights.keys()), np.zeros(len(classes)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        right, sure, n = right + (classes[p.argmax()] == c), sure + p.max(), n + 1
    assert right / n > 0.93 and abs(right / n - sure / n) < 0.05  # as often right as it says


# -- decontamination ---------------------------------------------------------------------------------------------
def _hits(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = H.words(t)
        for j in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[j : j + 8])].add(i)
    out = []
    for r in docs.collect():
        w, hit, found = H.words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if x := windows.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= x
        out.append((r.doc_id, len(w), len(hit), len(found), sorted(map(str, found))))
    return sorted(out)


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = H.documents(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    items = [(1, " ".join(text[10].split()[2:14])), (2, " ".join(text[12].split()[:8])), (3, "b"), (4, ""), (5, None), (10, "nothing of this occurs in any of the texts"), (11, "a a a a a a a a a a"), (12, " ".join(text[10].split()[5:20]).upper())]
    odd = spark.createDataFrame([(900, "a " * 40, "", "", 80), (901, text[12] + " x " + " ".join(text[10].split()[2:14]), "", "", 0)], H.SCHEMA)
    docs = docs.union(odd)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in decontaminate.contamination(H.clashing(docs), bench).collect())
    assert got == _hits(docs, items)
    clean = decontaminate.decontaminate(docs, bench.filter("item_id <> 3"))
    assert clean.schema == docs.schema
    assert decontaminate.contamination(clean, bench.filter("item_id <> 3")).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(H.empty(spark), bench).count() == 0


# -- quality -----------------------------------------------------------------------------------------------------
def test_quality_learns_from_rows_not_held_out(spark):
    rng = random.Random(4)
    good = [". ".join(H.sentence(rng, rng.randrange(4, 20)).capitalize() for _ in range(6)) for _ in range(150)]
    bad = [" ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in H.sentence(rng, 60).split()) if i % 2 else (H.sentence(rng, 1) + " ") * 50 for i in range(100)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([*rows, (900, None, "", "", 0), (901, "", "", "", 0), rows[0]], H.SCHEMA)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = spark.createDataFrame([(i, (0 if i in held else 1) if i < 150 else (1 if i in held else 0), 0) for i, *_ in rows] + [(None, 1, 0), (900, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(H.clashing(docs), labels).toPandas()  # held-out labels are wrong on purpose
    assert len(got) == docs.count() and got.score.between(0, 1).all() and set(got.doc_id[got.held_out & (got.doc_id < 900)]) == held
    assert (got.predicted == (got.score >= 0.3)).all()
    real = got[got.doc_id < 900]
    assert ((real.predicted == 1) == (real.doc_id < 150)).mean() > 0.97
    assert quality.classify(docs, labels.limit(0)).count() == docs.count() and quality.classify(H.empty(spark), labels).count() == 0
    assert quality.keep_good(docs, labels).schema == docs.schema


def test_quality_on_held_out_rows_of_the_corpus(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    auc = ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()
    assert len(good) > 20 and len(bad) > 5 and auc > 0.97 and (got.predicted == got.quality).mean() > 0.9


def test_quality_takes_columns_of_any_name_and_very_long_texts(spark):
    long = "A fine day. " * 200_000
    docs = spark.createDataFrame([(1, long), (None, "x"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("whole", "_text", "x", "score")})
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 3 and quality.keep_good(docs, labels).columns == docs.columns  # no labels: all score 0.5


# -- URLs --------------------------------------------------------------------------------------------------------
def test_url_filter_against_brute_force(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    rng = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.org"]
    entries = [("host", rng.choice([*hosts, "org"]), rng.choice(["block", "allow"]), day(rng.randrange(300))) for _ in range(40)] + [("url", "x.org/p", "block", day(50)), ("prefix", "x.org/p", "review", day(20)), (None, "x.org", "block", day(1)), ("host", None, "block", day(1))]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in ("a.example.com", "B.example.com:80", "u@x.org", "z.x.org") for p in ("", "/p", "/p/q?x=1#y", "/")] + [None, "", "no url", "mailto:x@x.org"]
    pages = [(i, u, day(rng.randrange(320))) for i, u in enumerate(urls * 4)] + [(1, urls[1], None), (None, urls[0], day(3))] * 2
    got = {(r.page_id, r.url, r.fetched_on): (r.verdict, r.pattern, r.since, r.n_rows) for r in urlfilter.verdicts(spark.createDataFrame(pages, "page_id long, url string, fetched_on date").withColumn("kind", F.lit("k")), spark.createDataFrame(entries, "kind string, pattern string, action string, listed_on date")).collect()}
    import re

    def verdict(url, on):
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        if not m or not m[1] or on is None:
            return "none", None, None
        name, bare = m[1].lower(), re.sub("/$", "", re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", re.sub(r"[?#].*$", "", url)))
        parts = name.split(".")
        keys = [("url", bare), ("prefix", "/".join([name, (bare.split("/") + [""])[1]])), *(("host", ".".join(parts[i:])) for i in range(len(parts)))]
        for kind, pattern in keys:
            past = [(d, a) for k, p, a, d in entries if (k, p) == (kind, pattern) and d <= on]
            if past:
                since, action = max(past)
                return action, pattern, since
        return "none", None, None

    want = collections.Counter(pages)
    assert got == {k: (*verdict(k[1], k[2]), n) for k, n in want.items()}


# -- neighbours --------------------------------------------------------------------------------------------------
def test_neighbours_recall_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 20)
    rng = np.random.RandomState(6)
    m = rng.standard_normal((900, 8)).astype(np.float32)
    m[300:600] = m[300]
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [1.0] * 3), (None, [1.0] * 8), rows[40]]
    got = neighbours.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))).toPandas()
    x, hit = m.astype(float), []
    for q in range(0, 900, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 9))) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id])
        hit.append(len(set(order) & set(mine.vec_id)) / 20)
    assert np.mean(hit) >= 0.9 and set(got.query_id) == set(range(0, 900, 20))
    few = neighbours.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert len(few) == 2 and neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_canonical_json():
    assert toolchat.canonical({"b": [1, "é"], "a": None}) == json.dumps({"a": None, "b": [1, "é"]}, separators=(",", ":"), ensure_ascii=False)


def test_jaccard_join_keeps_texts_apart_that_share_an_id_or_have_none(spark):
    rng = random.Random(11)
    a, b = H.sentence(rng, 60), H.sentence(rng, 60)
    rows = [(1, a), (1, b), (2, b + " x"), (None, a + " y"), (None, b), (3, a), (3, a), (None, "u v w"), (None, "u v w"), (4, ""), (4, ""), (5, None)]
    full = [(i, t, "en", "s", 0) for i, t in rows]
    texts = [r[1] or "" for r in rows]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := H.words(t)) else set() for t in texts]
    linked = lambda i, j: bool(sets[i] and sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    low = {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: None, 8: None, 9: 4, 10: 4, 11: 5}  # texts a (3 and 1), b (1 and 2)
    want = sorted(((r[0], low[i], n[i]) for i, r in enumerate(rows)), key=repr)
    for order in (full, full[::-1]):
        docs = spark.createDataFrame(order, H.SCHEMA).repartition(3)
        assert sorted(map(tuple, jaccard.join(docs).collect()), key=repr) == want
        for c in ("_gone", "row", "kept"):
            kept = jaccard.keep_one(spark.createDataFrame(order, H.SCHEMA).withColumn(c, F.lit(1)))
            assert kept.columns[-1] == c
            assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(_kept_of(spark, rows, linked), key=repr)


def _kept_of(spark, rows, linked):
    """One row of each class: the smallest id (null last), then the smallest digest of the text."""
    th = [r[0] for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                up = [up[j] if u == up[i] else u for u in up]
    words = [bool(H.words(t)) for _, t in rows]
    best = {}
    for i, (d, _) in enumerate(rows):
        if words[i]:
            k = (d is None, d or 0, th[i])
            best[up[i]] = min(best.get(up[i], (k, i)), (k, i))
    return [rows[i] for _, i in best.values()] + [r for r, w in zip(rows, words, strict=True) if not w]
