"""Alignment, whitening and secret scans on awkward tables, against plain versions of what they promise."""

from __future__ import annotations

import collections
import hashlib
import json
import re
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import cases  # noqa: E402

from talktally.llm import alignment, secret_scan, whitening  # noqa: E402
from talktally.session import scratch_path  # noqa: E402

CLASHING = "row string, block int, blob int, x int, spans int, component int, n int, text_ string, places int, values int, salt int, run int, n_a int, task int"
MORE = [
    (201, "a▁b with a mark of the other side", "en", "a", 1),
    (202, "x\x00y\ttab\r\nline \x1c end", "en", "a", 1),
    (203, "<s> <|endoftext|> </s> <unk>", "en", "a", 1),
    (204, "é\n\n  ü 中文😀 ''s    ", "en", "a", 1),
    (205, " ", "en", "a", 1),
    (206, "word " * 30_000, "en", "a", 1),
    (207, "unbroken" * 20_000, "en", "a", 1),
]
ROWS = [*cases.rows(), *MORE]


def table(spark, rows, schema, clashing=CLASHING):
    names = {c.split()[0] for c in schema.split(", ")}
    extra = [c for c in clashing.split(", ") if c.split()[0] not in names]
    return spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows], ", ".join([schema, *extra]))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS, cases.DOCS).repartition(5).cache()


# 11: alignment


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_tokenizers():
    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


def plain_alignment(text, tokenizers, plain):
    """(n_a, n_b, n_groups, digest, id pairs of the links) of one text, by comparing places in order."""
    none = (0, 0, 0, "", [])
    if not text:
        return none
    a, b = plain[0].encode(f" {text}", add_special_tokens=False).ids, plain[1].encode(text)
    sides = [[names[i].as_py() for i in ids] for ids, names in ((a, tokenizers.bytes_a), (b, tokenizers.bytes_b))]
    if any(b"".join(x) != f" {text}".encode() for x in sides):
        return none
    (ends_a, ends_b) = (np.cumsum([len(t) for t in x]).tolist() for x in sides)
    links, j = [], 0
    for i, end in enumerate(ends_a):
        start = ends_a[i - 1] if i else 0
        while ends_b[j] <= start:
            j += 1
        k = j
        while k < len(b) and (ends_b[k - 1] if k else 0) < end:
            links.append((a[i], b[k]))
            k += 1
    groups, i, j = [], 0, 0
    for cut in sorted({*ends_a} & {*ends_b}):
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def test_alignment_equals_comparing_all_places(spark, docs, tokenizers, plain_tokenizers):
    alone = {t: plain_alignment(t, tokenizers, plain_tokenizers) for t in {r[1] for r in ROWS}}
    holders = collections.Counter(p for r in ROWS for p in set(alone[r[1]][4]))
    highest = collections.Counter()
    for (a, _), n in holders.items():
        highest[a] = max(highest[a], n)
    want = collections.Counter()
    for doc_id, text, *_ in ROWS:
        n_a, n_b, n_groups, digest, links = alone[text]
        best = sum(holders[p] == highest[p[0]] for p in links)
        want[doc_id, n_a, n_b, n_groups, len(links), best, sum(holders[p] for p in links), digest] += 1
    got = alignment.align(docs, keep=["doc_id"])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert alone["a▁b with a mark of the other side"][0] == 0 and alone["word " * 30_000][0] > 30_000


def test_alignment_in_full(docs, tokenizers, plain_tokenizers):
    got = alignment.align(docs.where("doc_id IN (1, 11, 15, 204)"), full=True)
    assert {"row", "block", "places", "text"} <= set(got.columns) and got.columns.count("n_a") == 1
    for r in got.collect():
        n_a, n_b, n_groups, _, links = plain_alignment(r.text, tokenizers, plain_tokenizers)
        assert (r.n_a, r.n_b, r.n_groups) == (n_a, n_b, n_groups) == (len(r.tokens_a), len(r.tokens_b), len(r.cuts))
        assert [(r.tokens_a[x.a], r.tokens_b[x.b]) for x in r.links] == links
        if n_a:
            assert (r.cuts[-1].a, r.cuts[-1].b) == (n_a, n_b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(1, 9), st.randoms())
def test_lockstep_of_random_ends_in_lanes_of_any_length(sizes, lane, r):
    """One side's token sizes at random, the other's a random coarsening and splitting of the same bytes."""
    ends_a, ends_b, rows, base = [], [], [0], 0
    for one in sizes:
        total = sum(one)
        ends_a += (base + np.cumsum(one)).tolist()
        ends_b += [base + x for x in range(1, total) if r.random() < 0.4] + [base + total]
        base += total
        rows.append(len(ends_a))
    got = alignment.lockstep(np.array(ends_a), np.array(ends_b), np.array(rows), lane)
    starts_a, starts_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    want = [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if max(starts_a[i], starts_b[j]) < min(ends_a[i], ends_b[j])]
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want
    assert list(zip(got[2].tolist(), got[3].tolist(), strict=True)) == [(i, ends_b.index(e)) for i, e in enumerate(ends_a) if e in ends_b]


def test_texts_are_cut_only_where_no_token_crosses(tokenizers, plain_tokenizers):
    text = " " + "".join(t for _, t, *_ in ROWS[:40] if t)
    parts = alignment.cut_at_spaces(text, 50)
    assert "".join(parts) == text and len(parts) > 5
    assert [i for p in parts for i in plain_tokenizers[0].encode(p, add_special_tokens=False).ids] == plain_tokenizers[0].encode(text, add_special_tokens=False).ids


ODD = [*"  \n\t\r\x1c\x85\xa0\u3000\u180e\u200b", " ", " ", "  ", *"ab1!?é▁中😀", "the", "'s", "<s>", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), min_size=1, max_size=30).map("".join))
def test_parts_have_the_tokens_of_the_whole_text(tokenizers, plain_tokenizers, text):
    a, b = plain_tokenizers
    parts = tokenizers.parts(text)
    assert " ".join(parts) == text
    assert [i for p in parts for i in a.encode(f" {p}", add_special_tokens=False).ids] == a.encode(f" {text}", add_special_tokens=False).ids
    # B takes the mark for a space, so a text with one has no tokens; its parts need not be those of the whole.
    assert "▁" in text or [i for p in parts for i in b.encode(p)] == b.encode(text)


def test_each_distinct_part_of_a_block_is_encoded_once(tokenizers, plain_tokenizers, monkeypatch):
    words = [f"word{k}" for k in range(300)]
    texts = [" ".join(words[k % 7 :: 1 + k % 3]) for k in range(100)] + ["a▁b word1", None, ""]
    encode, given_ = alignment.Tokenizers.encode, []
    monkeypatch.setattr(alignment.Tokenizers, "encode", lambda self, parts: given_.extend(parts) or encode(self, parts))
    block = alignment.Block(tokenizers, texts)
    assert sorted(given_) == sorted({w for t in texts if t for w in t.split(" ")})
    want = [plain_alignment(t, tokenizers, plain_tokenizers) for t in texts]
    got = zip(block.n_a.tolist(), block.n_b.tolist(), block.n_groups.tolist(), block.digests(tokenizers), block.n_links.tolist(), strict=True)
    assert list(got) == [(*w[:4], len(w[4])) for w in want]
    pairs, holders = block.pairs()[:2]
    held = collections.Counter(p for w in want for p in set(w[4]))
    assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(pairs.tolist(), holders.tolist(), strict=True)} == held


def test_texts_stay_whole_where_a_token_goes_over_a_space(plain_tokenizers, tmp_path):
    letters = alignment.byte_letters()
    merges = [["a", "Ġ"], ["aĠ", "b"]]
    vocab = {t: k for k, t in enumerate([*letters, *map("".join, merges)])}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None}
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    spec["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None}
    spec["model"] |= {"fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": merges}
    (tmp_path / "over.json").write_text(json.dumps(spec))
    over = alignment.Tokenizers(f"{tmp_path}/over.json", "/opt/tokenizers/piece_bpe_32k.model")
    plain = (Tokenizer.from_file(f"{tmp_path}/over.json"), plain_tokenizers[1])
    text = "xa b" * 20_000
    assert over.parts(text) == [text]
    n_a, n_b, n_groups, digest, links = plain_alignment(text, over, plain)
    block = alignment.Block(over, [text, None])
    assert [x.tolist() for x in (block.n_a, block.n_b, block.n_groups, block.n_links)] == [[x, 0] for x in (n_a, n_b, n_groups, len(links))]
    assert block.digests(over) == [digest, ""] and n_a == 2 * 20_000 + 1


def test_alignment_of_empty_tables_and_texts(spark, docs):
    assert alignment.align(docs.limit(0)).count() == 0
    none = alignment.align(docs.where("text IS NULL OR text = ''"), keep=["doc_id"]).collect()
    assert none and {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "")}


# 12: whitening

VECTORS = "vec_id long, embedding array<float>"


def vectors(n=400, d=24, seed=5):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d))
    out = [(i, (r.normal(size=d) @ mix + 3).astype("float32").tolist()) for i in range(n)]
    odd = [(1000, None), (1001, [None] + [0.0] * (d - 1)), (1002, [float("nan")] * d), (1003, [float("inf")] + [1.0] * (d - 1)), (1004, []), (1005, [1.0, 2.0]), (None, out[3][1])]
    return out + odd + [out[0]] * 150 + [(7000 + k, out[1][1]) for k in range(100)]  # repeated rows, and copies under other ids


def plain_whitening(rows, most=16):
    good = [(i, v) for i, v in rows if v and len(v) > 2 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1][:most], vectors_[:, ::-1][:, :most]
    z = (x - sums / n) @ vectors_ / np.sqrt(values)
    return [i for i, _ in good], n, ((n * x - sums) ** 2).sum(1), z, values / np.trace(centred.T @ centred / n)


def test_whitening_equals_the_definition(spark):
    rows = vectors()
    got = whitening.whiten(table(spark, rows, VECTORS).repartition(5), keep=["vec_id"])
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r.component].append(r)
    ids, n, deviation, z, explained = plain_whitening(rows)
    assert sorted(found) == list(range(1, 17))
    for c, part in found.items():
        assert {r.n for r in part} == {n} and all(r.identity_error < 1e-9 for r in part)
        assert all(abs(r.explained / explained[c - 1] - 1) < 1e-9 for r in part)
        sign = np.sign(next(r.whitened for r in part if r.vec_id == ids[0]) * z[0, c - 1])
        mine = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, round(sign * r.whitened, 6) + 0.0) for r in part)
        want = sorted((-1 if i is None else i, int(s), round(float(w), 6) + 0.0) for i, s, w in zip(ids, deviation, z[:, c - 1], strict=True))
        assert [x[:2] for x in mine] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in mine], [x[2] for x in want], atol=2e-6)


def test_components_of_a_matrix_without_full_rank():
    r = np.random.default_rng(2)
    for n, rank in ((1, 1), (2, 1), (9, 4), (40, 40), (30, 0)):
        a = r.normal(size=(n, rank)) * 10.0 ** -np.arange(rank).clip(0, 6)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12 * max(v.max(initial=0), 1))
        assert np.allclose(np.triu(factor, 1), 0)
        values, vectors_ = whitening.components(v, n)
        want = np.linalg.eigvalsh(v)[::-1]
        assert len(values) <= max(rank, 0) + 1 and np.allclose(values, want[: len(values)], rtol=1e-6, atol=1e-12 * max(want[0], 1))
        assert np.allclose(vectors_ @ vectors_.T, np.eye(len(values)), atol=1e-12)
        assert np.allclose(v @ vectors_.T, vectors_.T * values, atol=1e-10 * max(want[0], 1))


def test_every_pair_of_columns_is_rotated_once_a_sweep():
    for n in range(0, 12):
        pairs = [(int(x), int(y)) for p, q in whitening.rounds(n) for x, y in zip(p, q, strict=True)]
        assert sorted(pairs) == [(x, y) for x in range(n) for y in range(x + 1, n)]


def test_whitening_of_few_and_of_extreme_vectors(spark):
    def run(rows):
        return whitening.whiten(table(spark, rows, VECTORS))

    assert run([]).count() == 0 and run([(1, None)]).count() == 0 and run([(1, [1.0, 2.0])] * 3).count() == 0
    two = run([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [float("inf"), 0.0]), (4, [3e38, 0.0])])
    assert {"row", "x", "embedding", "salt"} <= set(two.columns)
    assert sorted((r.vec_id, r.component, r.n, abs(round(r.whitened, 9))) for r in two.collect()) == [(1, 1, 2, 1.0), (2, 1, 2, 1.0), (2, 1, 2, 1.0)]
    apart = whitening.Whitening.__new__(whitening.Whitening)
    apart.n, apart.sums = 3, np.array([0])
    assert apart.deviation(np.array([[10**9], [2**40]])) == [9 * 10**18, None]


# 13: secret scans

SECRETS = [
    (301, 'config: PassWord = "hunter22" and password: token: abcdefgh, pwd=no', "en", "a", 1),
    (302, "AKIA" + "Q" * 16 + " AKIAshort AKIAAKIA" + "7" * 14, "en", "a", 1),
    (303, "f" * 23 + " " + "0123456789abcdef" * 2 + "G" + "a" * 24, "en", "a", 1),
    (304, "中文😀 api_key:'" + "x" * 6 + "' apikey=12345 Api-Key=1234567 toKen=abcdefgh ſecret=abcdefgh", "en", "a", 1),
    (305, "-----BEGIN RSA PRIVATE KEY----- https://user:passw0rd@host/ eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "en", "a", 1),
    (306, "secret=\n" * 3 + "word " * 100_000 + "secret=" + "z" * 40, "en", "a", 1),
]


def plain_base(text):
    """Base spans, by start and kind, of patterns written out for either case."""
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = re.compile(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(spans)]


@pytest.fixture(scope="module")
def secret_docs(spark):
    rows = [*ROWS, *SECRETS, SECRETS[1], (None, SECRETS[1][1], None, None, None), *((400 + k, SECRETS[2][1], "en", "hot", 1) for k in range(60))]
    return table(spark, rows, cases.DOCS).repartition(5).cache()


def base_of(row):
    return [tuple(x) for x in row.spans if x.kind in ("assign", "access", "hex")]


def test_base_spans_of_every_row(spark, secret_docs):
    got = secret_scan.scan(secret_docs, scratch_path(spark, "ledger"), "one", keep=["doc_id", "text", "salt"])
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "salt", "blob", "spans"] and len(rows) == secret_docs.count()
    for r in rows:
        assert base_of(r) == plain_base(r.text or "")
        assert [x.start for x in r.spans] == sorted(x.start for x in r.spans)
        assert bytes(r.blob) == hashlib.sha256((r.text or "").encode()).digest()
    kinds = {x.kind for r in rows for x in r.spans}
    assert kinds == {r.kind for r in secret_scan.RULES}


def test_only_unseen_blobs_and_rules_are_read(spark, secret_docs):
    ledger = scratch_path(spark, "ledger")
    blobs = secret_docs.select(F.coalesce("text", F.lit(""))).distinct().count()

    def entered(run):
        rows = secret_scan.ledger_rows(spark, ledger).where(F.col("run") == run)
        return rows.count(), rows.select(F.explode("rules")).distinct().count()

    half = secret_docs.where("doc_id % 2 = 0")
    first = half.select(F.coalesce("text", F.lit(""))).distinct().count()
    secret_scan.scan(half, ledger, "one", secret_scan.BASE).count()
    assert entered("one") == (first, 3)
    both = secret_scan.scan(secret_docs, ledger, "two", secret_scan.BASE)
    want = {(r.doc_id, r.text): base_of(r) for r in both.collect()}
    assert entered("two") == (blobs - first, 3) and want[301, SECRETS[0][1]] == plain_base(SECRETS[0][1])
    # Nothing new: moved and copied texts cost no scan.
    moved = secret_docs.withColumn("doc_id", F.col("doc_id") + 10_000)
    again = {(r.doc_id, r.text): base_of(r) for r in secret_scan.scan(moved, ledger, "three", secret_scan.BASE).collect()}
    assert entered("three") == (0, 0) and again == {(None if d is None else d + 10_000, t): x for (d, t), x in want.items()}
    # One rule in a new version: only it reads all blobs again, and its earlier findings no longer count.
    shorter = (*secret_scan.BASE[:2], secret_scan.Rule("hex", "[0-9a-f]{10,}"))
    changed = secret_scan.scan(secret_docs, ledger, "four", shorter)
    assert entered("four") == (blobs, 1)
    assert [len(base_of(r)) for r in changed.where("doc_id = 303").collect()] == [3]
    # The same run again replaces its entries.
    assert secret_scan.scan(secret_docs, ledger, "four", shorter).count() == secret_docs.count() and entered("four") == (blobs, 1)


def test_scan_of_an_empty_table(spark, secret_docs):
    ledger = scratch_path(spark, "ledger")
    assert secret_scan.scan(secret_docs.limit(0), ledger, "one").count() == 0
    assert secret_scan.ledger_rows(spark, ledger).count() == 0


def test_digest_columns(spark, tmp_path):
    table(spark, SECRETS, cases.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    for r in secret_scan.op13_secret_scan(spark, str(tmp_path)).collect():
        spans = plain_base(dict((x[0], x[1]) for x in SECRETS)[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [x for x in text.split(",") if x]
