"""Each operator on edge cases and against a plain form."""

import base64
import math
import random
import time
import zlib

import brute_jaccard
import brute_lm
import brute_spans
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typolith.llm import chat, decontamination, elias_fano, jaccard_join, lm_scoring, packing, pii, secrets, sharding, topk, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = ["", None, "One two", "one TWO", LONG, LONG + " extra", "alpha beta gamma delta epsilon zeta", "same text twice here now ok", "same text twice here now ok", "mail a@b.co and 10.0.0.1"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else "s", i, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int")


def _empty(df):
    return df.filter("false")


def test_packing(docs):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_files()[0])
    for i, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in own)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= packing.SEQUENCE
    assert packing.pack_documents(_empty(docs)).count() == 0


def test_quick_ids_match_the_tokenizer():
    path, ranks = packing.tokenizer_files()
    odd = ["a  b", "  a", "a \n b", "<|endoftext|> x", " \n \n x", "it's ok.", "é,, l'été. 1.5, x", "  a.", "a ", ".", "x.,", "日本 \u3000語", "\u0378 \U0001f600", "x\x85\x1c y", "", None]
    dice = random.Random(1)
    signs = [chr(c) for c in range(0x250)] + [" ", "\n", "'s", "<|endoftext|>"] * 60
    odd += ["".join(dice.choices(signs, k=dice.randint(0, 30))) for _ in range(3000)]
    blocks = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not packing._UNSETTLED.search(chr(c))]
    odd += [f"a{c}a1{c}1 {c}.{c} {c}{c}b" for c in blocks]
    assert list(packing.token_bytes(odd, path, ranks)) == list(packing.token_bytes(odd, path))


def test_pack_respects_every_limit():
    demands = np.array([[700, 1, 100], [700, 1, 900], [600, 1, 0], [50, 1, 50], [50, 1, 50], [50, 1, 0]])
    ids, _ = packing.pack(demands, np.array([1500, 3, 950]))
    for s in set(ids):
        assert (demands[ids == s].sum(axis=0) <= [1500, 3, 950]).all()


def test_toxicity_penalty_shrinks_swaps():
    rows = [(1, [0, 2], [1, 2])] * 8 + [(0, [1], [0])] * 8 + [(1, [2], None)] * 4 + [(0, [], None)] * 10
    gap = lambda p: abs(np.subtract(*toxicity.train(rows, 3, penalty=p)[0][:2]))
    assert gap(2.0) < 0.5 * gap(0.0)


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(i, None if i == 5 else i % 2) for i in range(10)], "doc_id long, toxic int")
    for table in (labels, _empty(labels)):
        out = toxicity.score(docs, toxicity.fit(docs, table)).collect()
        assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 for r in out)


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog while seventeen clever engineers quietly watch from a distant hill"
    near = item.replace("clever", "klever").upper()
    rows = [(1, "intro " + item + " end"), (2, "x " + near), (3, "nothing at all"), (4, None), (5, ""), (6, item[:40]), (7, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "short")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(docs, bench).collect()} == {1, 2}
    assert {r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()} == {3, 4, 5, 6, 7}
    assert decontamination.find_leaks(docs, _empty(bench)).count() == 0


def test_secrets():
    import base64
    import json

    part = lambda o: base64.urlsafe_b64encode(json.dumps(o, separators=(",", ":")).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.abcdef"
    der = bytes([0x30, 0x26, 0x02, 0x10]) + bytes(range(1, 17)) + bytes([0x02, 0x12]) + bytes(range(2, 20))
    assert secrets.is_der_key(der) and not secrets.is_der_key(der[:-1])
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))
    text = f"ü {jwt} and {base64.b64encode(der).decode()} or {base64.b64encode(ssh).decode()} token='abcdef' AKIA{'A' * 16} {'0f' * 12}"
    assert {k for k, _, _ in secrets.scan(text)} == {"jwt", "der", "ssh", "assign", "access", "hex"}
    assert secrets.scan(None) == secrets.scan("") == [] and secrets.scan("eyJx.eyJy.z " + "A" * 60) == []
    assert "[SECRET]" in secrets.redacted(text) and jwt not in secrets.redacted(text)


def test_secrets_in_odd_places():
    numbers = bytes.fromhex("02010002820101" + "00" + "c3" * 256 + "0210" + "51" * 16)
    der = b"\x30\x82" + len(numbers).to_bytes(2, "big") + numbers
    body = base64.b64encode(der).decode()
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}', b"0123456789abcdef"))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    spans = lambda t: [(k, t[a:b]) for k, a, b in secrets.scan(t) if k in ("pem", "jwt", "der", "ssh")]
    for text in (begin + "\\n" + "\\n".join(lines) + "\\n" + end, f"{begin}\nProc-Type: 4\n\n" + "\n".join(lines) + "\n" + end):
        assert ("pem", text) in spans(text)
    assert spans(f"endpoint.{jwt}") == [("jwt", jwt)] and spans(f"keys/{body}")[0][0] == "der"
    assert ("der", "\n".join(lines)) in spans("x\n" + "\n".join(lines))
    field = lambda x: len(x).to_bytes(4, "big") + x
    public = field(b"ssh-ed25519") + field(b"k" * 32)
    held = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(b"p" * 64)
    assert secrets.is_ssh_key(held) and not secrets.is_ssh_key(b"openssh-key-v1\0 and some plain words follow")
    began = time.time()
    assert spans((begin + "\n") * 50_000) == [] and spans("M/" * 200_000) == [] and spans("ey." * 200_000) == [] and time.time() - began < 10


def test_base_secrets_against_plain_patterns():
    rng = random.Random(9)
    bits = ["password", "API_KEY", "secret", "token", '"', "'", " ", ":", "=", "abc123", "x.y-z", "AKIA", "AKIA" + "B7" * 9, "0123456789abcdef" * 2, "é", "\n", "zz"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert [s for s in secrets.scan(text) if s[0] in secrets.KINDS[:3]] == brute_spans.secrets(text)


def test_secrets_rows(docs):
    out = secrets.find_secrets(docs).collect()
    assert len(out) == len(TEXTS) and secrets.redact_secrets(docs).columns == docs.columns


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    data += [(300, data[0][1]), (301, data[0][1]), (302, None), (303, [float("nan")] * 8), (304, [None] * 8), (305, [1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, k=5).collect()}
    whole = {i: np.array([math.floor(64 * x) for x in v] + [0] * (8 - len(v))) for i, v in data if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in whole if i % 20 == 0]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    assert topk.top_k(_empty(table), F.lit(True)).count() == 0


def test_top_k_prunes_clusters():
    rng = np.random.default_rng(8)
    for dims in (2, 64):
        centres = rng.normal(size=(40, dims)) * 100
        points = np.round(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, dims)))
        asks = points[::20]
        found = topk.Search(asks, np.arange(0, 4000, 20), points, np.arange(4000), 10)
        scores = asks @ points.T
        scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
        order = np.lexsort((np.broadcast_to(np.arange(4000), scores.shape), -scores))[:, :10]
        assert (found.best_ids == order).all() and (found.best == np.take_along_axis(scores, order, 1)).all()
        assert found.pruned > 100 and found.opened > 0 and found.scored < 0.15 * scores.size


def test_elias_fano(tmp_path):
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 50_000).astype(np.uint64))
    elias_fano.EliasFano.write(str(tmp_path / "x"), values)
    seq = elias_fano.EliasFano(str(tmp_path / "x"))
    places = np.unique(np.random.default_rng(2).integers(0, 50_000, 900))
    assert (seq.at(np.arange(50_000)) == values).all() and (seq.at(places) == values[places]).all()
    queries = np.sort(np.concatenate([values[::7], values[::11] + np.uint64(1)]))
    position, equal = seq.successor(queries)
    assert (position == np.searchsorted(values, queries)).all() and (equal == np.isin(queries, values)).all()


def test_trie(tmp_path):
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 40, (500, 2)), axis=0)
    values = rng.normal(size=len(pairs))
    elias_fano.Trie.write(str(tmp_path), 45, pairs[:, 0], pairs[:, 1].astype(np.uint64) * np.uint64(99_999_999), values)
    trie = elias_fano.Trie(str(tmp_path))
    asks = np.array([(w, c) for w in range(45) for c in range(45)])
    codes = trie.codes(asks[:, 0], asks[:, 1].astype(np.uint64) * np.uint64(99_999_999)).astype(float)
    want = dict(zip(map(tuple, pairs.tolist()), values, strict=True))
    for ask, code in zip(map(tuple, asks.tolist()), codes, strict=True):
        assert (code > 0) == (ask in want)
        assert ask not in want or trie.low + trie.step * (code - 1) == pytest.approx(want[ask], abs=trie.step)


@pytest.mark.parametrize("sizes", [lm_scoring.Sizes(), lm_scoring.Sizes(400, 60)])
def test_lm_scoring(spark, sizes):
    rng = random.Random(6)
    texts = [*TEXTS, *(" ".join(rng.choice(["the", "the", "The", "of", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(40))) for _ in range(60))]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int")
    out = {r.doc_id: r for r in lm_scoring.score_texts(table, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, sizes=sizes).collect()}
    for i, want in brute_lm.scores(list(enumerate(texts)), lm_scoring.MASS).items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9) and r.score == pytest.approx(want[5], abs=1e-4 * want[1])


def test_lm_scoring_of_odd_rows(spark, docs):
    assert lm_scoring.score_texts(_empty(docs), F.lit(False)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in lm_scoring.score_texts(rows, F.lit(True)).collect()), key=str)
    assert out == sorted([(None, 3, 0, 0), (1, 1, 0, 0), (1, 3, 0, 0)], key=str)


def test_streamed_log_folds_to_its_turns(spark):
    rows = [(1, 0, "user", "ask <b>"), (1, 1, "assistant", "answer \\# é"), (1, 1, "assistant", "answer \\# é"), (1, None, "user", "late"), (2, 5, "assistant", None), (2, 6, None, "x"), (None, 0, "assistant", "a")]
    log = chat.streamed_events(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "edit", "delta", "regenerate"}
    out = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(chat.render(chat.fold_events(log))).collect()}
    assert out[1] == ([("user", "ask <b>"), ("assistant", "answer \\# é"), ("assistant", "answer \\# é"), ("user", "late")], "answer \\# é" * 2)
    assert out[2] == ([("assistant", ""), ("", "x")], "") and out[None] == ([("assistant", "a")], "a")


def test_chat_folds_events(spark):
    log = [(1, "m", 1, "delta", "assistant", "Hel"), (1, "m", 2, "delta", "assistant", "lo"), (1, "m", 3, "regenerate", "assistant", None), (1, "m", 4, "delta", "assistant", "Hi <b>\\#"), (1, "u", 0, "message", "user", "old"), (1, "u", 5, "edit", "user", "new"), (None, "z", 1, "message", None, None), (1, "q", 9, "other", "user", "no")]
    table = spark.createDataFrame(log, "conv_id long, message_id string, seq long, kind string, role string, content string")
    out = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(table))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "new"), ("assistant", "Hi <b>\\#")] and out[1].loss_text == "Hi <b>\\#"
    assert [tuple(t) for t in out[None].turns] == [("", "")]


def test_pii(docs, spark):
    edge = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "+1 (743) 555-3824.", "4111 1111 1111 1111 x", "00255.1.2.3", "\U0001f600 a@b.co", "1" * 9000, *TEXTS]
    table = spark.createDataFrame(list(enumerate(edge)), "doc_id long, text string")
    for r in pii.find(table).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == brute_spans.pii(edge[r.doc_id])
    assert pii.sanitise(table.filter("doc_id = 5")).first().text == "\U0001f600 [EMAIL]"


def test_pii_of_many_matches(spark):
    text = " ".join(f"10.{i % 256}.{i // 256}.7 word{i % 9}" for i in range(60_000))
    began = time.time()
    (row,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.kind, s.start, s.end) for s in row.base] == brute_spans.pii(text) and time.time() - began < 60


def test_pii_disclosing_term(spark):
    rows = [(i, f"{w} zanzibar writes to secret@site.org {w}") for i, w in enumerate(["aaaa", "bbbb", "cccc", "dddd"])] + [(i, "plain words only") for i in range(10, 200)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).filter("size(added) > 0").collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3}


def test_pii_rare_and_copied_entities(spark):
    rows = [(0, "quokka writes to rare@site.org"), *[(i, "wombat writes to copied@site.org") for i in range(1, 9)], *[(i, "plain words only") for i in range(10, 400)]]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (0, 6, True) in [tuple(s) for s in out[0].added]
    assert all((0, 6, True) in [tuple(s) for s in out[i].added] for i in range(1, 9))
    assert not out[10].added


def test_pii_terms_of_whole_texts(spark):
    far = "zanzibar xq" + " same words" * 40
    rows = [*[(i, f"{far} \U0001f600 far@site.org then far") for i in range(3)], (3, "only Zanzibar here, and ZANZIBAR"), *[(i, "plain same words here and only") for i in range(10, 200)]]
    out = {r.doc_id: [(s.start, s.end, s.sure) for s in r.added] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(0, 8, False), (9, 11, True)} <= set(out[0])
    assert out[3] == [(5, 13, False), (24, 32, False)]
    assert all(rows[0][1][a:b] in ("zanzibar", "xq", "then", "far") for a, b, _ in out[0])
    assert not out[10]


def test_jaccard_join(spark, docs):
    words = [f"w{i}" for i in range(80)]
    near = [(100 + k, " ".join(words[:k] + ["new"] + words[k + 1 :])) for k in range(0, 80, 9)]
    rows = [*enumerate(TEXTS), *near, (200, " ".join(words)), (201, " ".join(words[:60]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table).collect()}
    assert got == brute_jaccard.components(rows)


def _near_groups():
    """Groups of near copies on both sides of the threshold, a passage that many share, exact copies and short texts."""
    rng = np.random.default_rng(3)
    rows, shared = [], " ".join(f"p{i}" for i in range(30))
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(120)]
        for c in range(10):
            words = list(base)
            for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
                words[at] = f"x{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words) + (" " + shared if c % 3 == 0 else "")))
    rows += [(len(rows) + i, f"{shared} only {i}") for i in range(40)]
    return rows + [(len(rows) + i, rows[7][1]) for i in range(20)] + [(1000 + i, t) for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("sizes", [jaccard_join.Sizes(), jaccard_join.Sizes(700, 300, 4, 0)])
def test_jaccard_join_in_many_units(spark, sizes):
    rows = _near_groups()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table, sizes=sizes).collect()}
    want = brute_jaccard.components(rows)
    assert got == want
    assert sorted(r.doc_id for r in jaccard_join.first_of_each(table, sizes=sizes).collect()) == sorted(d for d, (n, c) in want.items() if d == c)


def test_jaccard_join_of_odd_rows(spark):
    other, words = "these are quite other words than those", "one two three four five six seven eight"
    rows = [(1, words, "k", 5), (1, other, "r", 1), (2, words, "k", 2), (None, other + " x", "k", 3), (None, None, "k", 4), (3, "", "k", 6), (2, words, "k", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table).collect()), key=str)
    assert got == sorted([(1, 4, 1), (1, 3, 1), (2, 4, 1), (None, 4, 1), (None, 0, None), (3, 0, 3), (2, 4, 1)], key=str)
    kept = jaccard_join.first_of_each(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, words), (1, other), (None, None), (3, "")], key=str)
    assert jaccard_join.jaccard_components(table.limit(0)).count() == 0 and jaccard_join.first_of_each(table.limit(0)).count() == 0


def test_jaccard_pairs_within_a_group_are_not_all_verified(spark, monkeypatch):
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)] + [(i, 100) for i in range(30)]
    verified = []

    def linked(picked, texts):
        verified.extend((r.a, r.b) for r in picked.collect())
        return picked.filter("b < 100 OR a = 17").select("a", "b")

    monkeypatch.setattr(jaccard_join, "_verified", linked)
    labels = spark.createDataFrame([(i, 0) for i in range(25)], "node long, label long")
    got = {r.node: r.label for r in jaccard_join._closed(spark.createDataFrame(pairs, "a long, b long"), None, labels).collect()}
    assert got == dict.fromkeys([*range(30), 100], 0) and len(set(verified)) == len(verified) < 80


def _near_misses(count, changed=3):
    """Texts of 200 words that differ in so many places: with three the overlap bound leaves most pairs, but none is linked."""
    rng = np.random.default_rng(8)
    out = []
    for i in range(count):
        words = [f"w{k}" for k in range(200)]
        for at in rng.permutation(20)[:changed]:
            words[8 * at + 20] = f"x{i}y{at}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("items", [1 << 20, 9000])
def test_jaccard_trees_send_no_more_rows_than_texts(spark, items):
    sets = list(jaccard_join.sets_of(pa.array(_near_misses(120))))
    rows = [(1, k, len(s), jaccard_join.point_of(s).tolist(), k, [1], 120, 0) for k, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "run long, key long, n long, point array<tinyint>, comp long, runs array<long>, members long, least long")
    assert len(jaccard_join.tree_join(np.stack([jaccard_join.folded(np.array(r[3]), 256) for r in rows]), np.array([r[2] for r in rows]), np.arange(120))[0]) > 3000
    assert jaccard_join._tree_pairs(table, 1024).count() <= 120
    left = jaccard_join._tree_pairs(table, 1024, items).collect()
    assert {r.a for r in left} == set(range(120)) and len(left) <= 120 * len({r.part for r in left})


@pytest.mark.parametrize("sizes", [jaccard_join.Sizes(), jaccard_join.Sizes(3000, 3000, 16, 0)])
def test_jaccard_join_of_a_large_group_of_near_misses(spark, monkeypatch, sizes):
    misses = _near_misses(60)
    texts = [*misses, *(t.replace(" w190 ", " v190 ") for t in misses[:20]), *_near_misses(15, 2), *[" ".join(f"w{k}" for k in range(n)) for n in (150, 160, 199)]]
    rows, seen = [(i, t) for i, t in enumerate(texts)], []
    whole = jaccard_join._linked_in_units
    monkeypatch.setattr(jaccard_join, "_linked_in_units", lambda members, texts: seen.append(members.count()) or whole(members, texts))
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), sizes=sizes).collect()}
    assert got == brute_jaccard.components(rows) and seen[0] > 0


def test_jaccard_links_of_a_unit_join_all_that_pairs_join():
    rng = np.random.default_rng(6)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.concatenate([rng.choice(base, 88, replace=False), rng.integers(1000, 1 << 60, 4).astype(np.uint64)])) for _ in range(40)] + [base + np.uint64(500)]
    comps = np.array([7] * 5 + list(range(100, 136)))
    a, b = np.triu_indices(41, 1)
    graph = {i: {i} for i in range(41)}

    def join(x, y):
        both = graph[x] | graph[y]
        for k in both:
            graph[k] = both

    for x in range(1, 5):
        join(0, x)
    links = jaccard_join.joining_links(sets, comps, a, b)
    assert all(jaccard_join.linked(sets[x], sets[y]) for x, y in links)
    for x, y in links:
        assert graph[x] is not graph[y]
        join(x, y)
    assert all(graph[x] is graph[y] for x, y in zip(a.tolist(), b.tolist(), strict=True) if jaccard_join.linked(sets[x], sets[y]))
    assert graph[40] == {40} and jaccard_join.joining_links(sets, comps, a, b, lambda x, y: False) == []


def test_components_go_on_from_labels(spark):
    from typolith.llm import graph

    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)], "a long, b long")
    labels = graph.components(chain)
    assert {r.node: r.label for r in labels.collect()} == dict.fromkeys(range(21), 0) | {50: 50, 51: 50, 60: 60}
    more = graph.components(spark.createDataFrame([(51, 70), (70, 13), (3, 4), (80, 81)], "a long, b long"), labels)
    assert {r.node: r.label for r in more.collect()} == dict.fromkeys([*range(21), 50, 51, 70], 0) | {60: 60, 80: 80, 81: 80}
    assert graph.components(chain.limit(0)).count() == 0 and graph.components(chain.limit(0), labels).count() == 24


def test_jaccard_tree_keeps_all_links():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(60)]
    sets += [np.sort(np.append(s[:-4], s[-4:] + np.uint64(1))) for s in sets]
    points, sizes = np.stack([jaccard_join.point_of(s) for s in sets]), np.array([len(s) for s in sets])
    a, b = jaccard_join.tree_join(points, sizes, np.arange(len(sets)))
    left = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    assert all((i, i + 60) in left for i in range(60))


def test_sharding(docs):
    out = sharding.stratified_shards(docs, shards=3).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        text = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 1, zlib.crc32(text))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.stratified_shards(_empty(docs)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert sorted(kept.columns) == sorted(docs.columns)
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()}
    assert packed == {r.doc_id for r in kept.collect()} and 0 < len(packed) < docs.count()
