"""Divergence audit, tokenizer alignment and id files against brute force, and their edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nazar.llm import align, divergence, idfiles, vocab

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, gid int, n string, start int, row int, place int, pairs string"
EXTRA = ("t", 1, "x", 2, 3, 4, "p")
LONG = "Ünï wörd don't I'M 12345 " * 8_000
TEXTS = [None, "", " ", "  two  spaces\n\n and\ttabs ", "a", "plain words of a text", "plain words of a text", "▁ is a sign", "<|endoftext|> and <s> </s> <0x41> <|startoftext|>x",
         "日本語のテキスト 🤦🏽‍♀️ é é", " x y\u0085z \x1c \x0b \x00", "İΣς ſ ŉ", "12345 3.14 -- !!! 'll 've's", LONG, "﻿bom ​ zero"]
ROWS = [(None if i == 3 else i // 2, t, None if i % 5 == 0 else "ab"[i % 2], None if i % 7 == 0 else "xyz"[i % 3], 0, *EXTRA) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def brute_audit(rows, min_docs, top=10):
    """rows: (lang, source, text)."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, Counter(terms(t))) for x, s, t in rows if x == lang]
        df = Counter(t for _, c in own for t in c)
        kept = [t for t, n in df.items() if n >= min_docs]
        groups = {s: Counter() for s, _ in own}
        for s, c in own:
            groups[s].update({t: n for t, n in c.items() if df[t] >= min_docs})
        whole = sum(groups.values(), Counter())
        prices = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: prices(c) for s, c in groups.items()}
        q = prices(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, i.decode(), -v, k) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_against_brute_force(spark, docs, odd):
    both = docs.select("lang", "source", "text").union(odd.select("lang", "source", "text"))
    rows = [tuple(r) for r in both.collect()]
    want = brute_audit(rows, 10)
    assert audited(both) == want and {r[2] for r in want} == {"pair", "term"}
    assert audited(odd, min_docs=1) == brute_audit([(r[2], r[3], r[1]) for r in ROWS], 1)
    assert audited(odd.limit(0)) == []
    types = dict(divergence.audit(odd).dtypes)
    assert types["value"] == "bigint" and types["rank"] == "int"


def test_audit_with_small_blocks_and_flushes(spark, docs, monkeypatch):
    for name, value in (("GROUPS", 3), ("COLUMNS", 8), ("TERMS", 16), ("TASK_ROWS", 500), ("LEVEL_ROWS", 40), ("HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert audited(docs, min_docs=4) == brute_audit(rows, 4)


def test_audit_sql(docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert audited(docs) == sorted(con.sql(divergence.SQL).fetchall())


def test_prices_of_large_counts(spark):
    df = spark.createDataFrame([(7 * 10**14, 9 * 10**14), (0, 3)], "n long, w long")
    from pyspark.sql import functions as F
    got = [r[0] for r in df.select(divergence.price(F.col("n"), F.col("w"))).collect()]
    assert got == [1 + 10**9 * (7 * 10**14 + 2) // (9 * 10**14), 1 + 2 * 10**9 // 3]


def test_joint_tables_are_indicator_products():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (50, 5))
    term, group = np.nonzero(counts)
    grid, at = divergence.indicators(term, 50, group, counts[term, group])
    table = (grid.T @ grid).astype(int)
    names = list(zip(group[at], counts[term, group][at], strict=True))
    for x, (g, c) in enumerate(names):
        for y, (h, d) in enumerate(names):
            assert table[x, y] == ((counts[:, g] == c) & (counts[:, h] == d)).sum()


def brute_alignment(texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(b) for b, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    ranks[50256] = b"<|endoftext|>"
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs = []
    for t in texts:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        toks = [[ranks[i] for i in ids[0]], [piece(i) for i in ids[1]]]
        if not t or any(b"".join(x) != b" " + t.encode() for x in toks):
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in toks]
        both = sorted(set(ends[0]) & set(ends[1]))
        at = [(np.searchsorted(np.array(e), both) + 1).tolist() for e in ends]
        groups = ";".join("|".join(",".join(map(str, ids[k][lo[k]:hi[k]])) for k in (0, 1)) for lo, hi in zip([(0, 0), *zip(*at, strict=True)], zip(*at, strict=True), strict=False))
        links, i, j = [], 0, 0
        while i < len(ids[0]):
            links.append((ids[0][i], ids[1][j]))
            step = ends[0][i] - ends[1][j]
            i, j = i + (step <= 0), j + (step >= 0)
        docs.append((len(ids[0]), len(ids[1]), len(both), links, groups))
    counts = Counter(x for d in docs if d for x in set(d[3]))
    best: dict = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else
            (*d[:3], len(d[3]), sum(counts[x] == best[x[0]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


def summarised(df, **kw):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(str(tuple(r)) for r in align.alignment_summary(df, **kw).select(cols).collect())


@pytest.mark.parametrize("shared", [align.SHARED_PAIRS, 25])
def test_alignment_against_brute_force(spark, docs, odd, shared, monkeypatch):
    if shared < align.SHARED_PAIRS:
        monkeypatch.setattr(align, "HELD_PAIRS", 100)
        monkeypatch.setattr(align, "SLICE_BYTES", 5_000)
        monkeypatch.setattr(align, "HELD_WORDS", 50)
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = both.collect()
    want = brute_alignment([r.text for r in rows])
    assert summarised(both, shared_pairs=shared) == sorted(str((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))
    assert sum(not w[0] for w in want) >= 3 and max(w[3] for w in want) > 50_000


def test_alignment_itself_and_empty_tables(spark, odd):
    for r in align.aligned(odd).collect():
        groups = list(zip(r.a_cuts, r.b_cuts, strict=True))
        if not groups:
            assert not r.a_ids and not r.b_ids and not r.links
            continue
        assert groups[-1] == (len(r.a_ids), len(r.b_ids)) and len(r.links) == len(r.a_ids) + len(r.b_ids) - len(groups)
        assert r.links[0] == (0, 0) and tuple(r.links[-1]) == (len(r.a_ids) - 1, len(r.b_ids) - 1)
    assert align.alignment_summary(odd.limit(0)).count() == align.aligned(odd.limit(0)).count() == 0
    assert align.alignment_summary(odd.where("text is null")).count() == 1


def test_words_align_as_whole_texts_do():
    files = [vocab.file_bytes(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    words = align.Words(*files)
    assert words.apart
    rng = np.random.default_rng(4)
    parts = [" ", "  ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u0301", "e", "word", "Word", "'s", "ll", "<s>", "<|endoftext|>", "日本", "🤦", "-", "...", "12", "\u00ad", "\u200d", "\x00", "\ufffd", "é", "▁"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 20))) for _ in range(3_000)]
    whole = align.align_texts(list(range(len(texts))), texts, *files)
    strings = dict(zip(whole.rows.tolist(), align.group_strings(whole, words.a_tok, words.b_tok), strict=True))
    codes = whole.a[whole.link_a] * len(words.b_tok) + whole.b[whole.link_b]
    of = whole.rows[whole.a_text[whole.link_a]]
    for i, t in enumerate(texts):
        cut = words.parts(t)
        words.learn(set(cut))
        found = [words.known[w] for w in cut]
        assert (None in found) == (i not in strings), repr(t)
        if i in strings:
            assert b";".join(f[3] for f in found) == strings[i], repr(t)
            assert b"".join(f[4] for f in found) == codes[of == i].astype("<i8").tobytes()
    assert 500 < len(strings) < len(texts)


def test_groups_and_links_of_crossing_ends():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a, b = (np.array(sorted({*rng.choice(n, rng.integers(0, n), replace=False).tolist(), n} - {0})) for _ in range(2))
        a_cut, b_cut = align.cut_by_ends(a, b)
        la, lb, _ = align.expand_links(a_cut, b_cut, a, b)
        begin = lambda e: np.r_[0, e[:-1]]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(begin(a)[i], begin(b)[j]) < min(a[i], b[j])]
        assert list(zip(la.tolist(), lb.tolist(), strict=True)) == want


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_packing_round_trip_and_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    for block in (1, 7, 64):
        path = f"{tmp_path}/{bits}-{block}.bits"
        lengths = [0, 1, 5, 130, 0, 64, 7]
        ids = [rng.integers(0, 1 << bits, n).astype("<u4") for n in lengths]
        out = idfiles.IdWriter(path, bits, block)
        for k, x in enumerate(ids):
            out.add(None if k == 2 else 10 * k, x)
        out.close()
        flat = np.concatenate(ids)
        r = idfiles.IdReader(path)
        assert idfiles.unpack(idfiles.pack(flat, bits), len(flat), bits).tolist() == flat.tolist()
        for _ in range(50):
            lo, hi = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
            assert r.ids(lo, hi).tolist() == flat[lo:hi].tolist()
        got = [(d, s, x.tolist()) for d, s, x in r.documents(20)]
        starts = np.cumsum([0, *lengths])
        assert got == [(None if k == 2 else 10 * k, int(starts[k]), x.tolist()) for k, x in enumerate(ids)]
        r.close()
    with pytest.raises(ValueError):
        (tmp_path / "other").write_bytes(b"x" * 100)
        idfiles.IdReader(f"{tmp_path}/other")


def test_words_give_the_ids_of_whole_texts(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    encode = idfiles.WordEncoder(vocab.file_bytes(path))
    rng = np.random.default_rng(2)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "́", "e", "E", "'s", "'", "ll", "<|startoftext|>", "<|endoftext|>", "ΑΣ", "İ", "ﬁ", "12", "日本", "ᄀ", "ᅡ", "🤦", "-", "</w>", "‍", "̈́", "Å"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(3_000)] + [r.text for r in docs.collect() if r.text] + [x for x in TEXTS if x]
    for step in (1, 500):
        for lo in range(0, len(texts) if step > 1 else 300, step):
            for x, ids in zip(texts[lo:lo + step], encode(texts[lo:lo + step]), strict=True):
                assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)[:200]


@pytest.mark.parametrize("by_word", [True, False])
def test_id_files_round_trip(spark, docs, odd, by_word, tmp_path):
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = both.collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(r.doc_id, [*(t.encode(r.text or "", add_special_tokens=False).ids), 1]) for r in rows]
    manifest = idfiles.write(both, folder=f"{tmp_path}/ids", by_word=by_word, file_bytes=50_000)
    got = sorted(((r.start, r.doc_id, r.ids) for r in idfiles.read(manifest).collect()), key=lambda r: r[0])
    assert sorted((str(d), i) for _, d, i in got) == sorted((str(d), i) for d, i in want)
    order = [-1 if d is None else d for _, d, _ in got]
    assert order == sorted(order) and [s for s, _, _ in got] == np.cumsum([0, *[len(i) for _, _, i in got]])[:-1].tolist()
    sums = {r.start: r for r in idfiles.checksums(manifest).collect()}
    assert all((sums[s].doc_id, sums[s].n_tokens, sums[s].ids_crc32) == (d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for s, d, i in got)
    files = manifest.collect()
    assert len(files) > 3 and sum(f.n_docs for f in files) == len(rows) and sum(f.n_ids for f in files) == sum(len(i) for _, i in want)
    assert idfiles.read(idfiles.write(odd.limit(0))).count() == 0
