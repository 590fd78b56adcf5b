"""The tokenizer operators against the libraries and plain loops."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tremor.llm import bpe_codec, common, tokenizer_alignment

pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, a string, b string, n long, block string, ids string"


def odd_texts(seed=1):
    rng = random.Random(seed)
    syllables = ["ba", "chen", "lich", "tion", "é", "ß", "ñá", "ing", "th", "Ver", "X", "'s", ",", ".", "1", "20", "-", "$"]
    prose = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    spaces = ["", " ", "\n", "\t ", "\r\n", "\r", "\x1c", "\x85", "\xa0", " ", "　", "​", "﻿", " ", "\x00", "᠎", "  \n "]
    mixed = ["".join(rng.choice(["foo", "Bar!", "é", "é", "日本", "🙂", "9", ";", ")", "}", "'ll", *spaces]) for _ in range(30)) for _ in range(60)]
    fixed = [
        "", " ", "\n\n", "a", " a ", "Hello<|endoftext|>it's <|startoftext|>x<|endoftext|>", "<|endoftext|", "<s> <unk> <0x41> </s>", "a▁b", "▁▁ x", "foo;\r\n  bar }\r\n", "x\r", "\r\ny",
        "İstanbul ΑΣ Ⅷ ﬁ ½ ² ŉ Ǆ ẞ Å ͅ", "don't WE'LL 's't're", "a" * 3000, "ab" * 800, "q" * 600 + " z", "مرحبا בדיקה हिन्दी", "\U0001f469‍\U0001f4bb", "0123456789" * 40, "́x", "x ́y", "%7B" * 30,
    ]
    return [*fixed, *mixed, *prose, prose[0], fixed[5]]


def docs_of(spark, texts):
    rows = [(i, t, "x", "y", 1, "z", "w") for i, t in enumerate(texts)] + [(None, texts[5], None, None, None, None, None), (None, None, None, None, None, None, None), (3, texts[3], "x", "y", 1, "z", "w")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


# -- encoding and decoding ------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_codec.default_path())


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(bpe_codec.default_path())


def by_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_codec_matches_the_library(spark, library):
    rows, docs = docs_of(spark, odd_texts())
    got = bpe_codec.encode_documents(docs).collect()
    want = []
    for r in rows:
        ids, shown = by_library(library, r[1])
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), ids, shown))
    assert sorted((str(g[0]), *g[1:]) for g in got) == sorted(want)
    plain = bpe_codec.encode_documents(docs, with_tokens=False)
    assert plain.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(g[0]), *g[1:]) for g in plain.collect()) == sorted(w[:4] for w in want)
    assert bpe_codec.encode_documents(docs.limit(0)).collect() == []


def test_plain_strings_are_cut_as_the_library_cuts_them(codec, library):
    """Every sign that is cut out here, alone and between others."""
    signs = [chr(i) for i in range(0x21, 0x180) if bpe_codec.PLAIN.fullmatch(chr(i))]
    texts = [f for c in signs for f in (c, f"a{c}b", f"1{c}.", f"É{c}{c}'s")]
    for text, (ids, shown) in zip(texts, codec.encode(texts), strict=True):
        assert (ids.tolist(), shown.tobytes()[:-1].decode()) == by_library(library, text), text


def test_random_words_and_a_small_store(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "KEEP", 50)
    monkeypatch.setattr(bpe_codec, "TOGETHER", 300)
    monkeypatch.setattr(bpe_codec, "LONG", 12)
    codec = bpe_codec.Codec(bpe_codec.default_path())
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aeinrstlhé") for _ in range(rng.randrange(1, 25))) for _ in range(30)) for _ in range(60)]
    for text, (ids, _) in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == by_library(library, text)[0]
    assert codec.exact and codec.decode(ids) == by_library(library, texts[-1])[1]


def test_very_long_texts_come_in_pieces(spark, library, monkeypatch):
    monkeypatch.setattr("tremor.llm.common.pieces.__defaults__", (50,))
    texts = ["word One <|endoftext|> é " * 40, "x" * 400 + " \n y", " " * 300]
    got = bpe_codec.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(g.ids, g.decoded) for g in got] == [by_library(library, t) for t in texts]


def test_clashes_and_merging_agree(codec):
    """Two tokens are neighbours after merging exactly if they don't clash."""
    m = codec.merges
    rng = np.random.default_rng(2)
    inner = np.array([i for i in range(m.size) if not m.names[i].endswith("</w>") and i not in m.added.values()])
    a, b = rng.choice(inner[:6000], 3000), rng.choice(m.size - 2, 3000)

    def spelt(i):
        return [i] if m.born[i] < 0 else spelt(m.left[i]) + spelt(m.right[i])

    merged = [m.merge([int(s) for s in spelt(x) + spelt(y)]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert (~m.clashes(a, b)).tolist() == merged and 0 < sum(merged) < 3000
    words = [spelt(x) + spelt(y) for x, y in zip(a[:300].tolist(), b[:300].tolist(), strict=True)]
    flat, counts = m.merge_all(np.array([s for w in words for s in w], np.int64), np.array([len(w) for w in words]))
    assert flat.tolist() == [x for w in words for x in m.merge([int(s) for s in w])] and len(counts) == 300


# -- alignment -------------------------------------------------------------------------


def by_loops(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_alignment.default_path(tokenizer_alignment.TOKENIZER_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_alignment.default_path(tokenizer_alignment.TOKENIZER_B))
    back = {**{chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    back |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if chr(c) not in back)}
    tokens = []
    for _, text, *_ in rows:
        if not text:
            tokens.append(([], []))
            continue
        e = a.encode(" " + text, add_special_tokens=False)
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in e.ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        tokens.append((x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], []))
    docs, counts = [], Counter()
    for x, y in tokens:
        spans = []
        for side in (x, y):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        cuts = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, _ in own if low <= s < cut) for own in spans))
            low = cut
        links = [(i, j) for i, s, e in spans[0] for j, p, q in spans[1] if s < q and p < e]
        counts.update(links)
        docs.append((len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(str(r[0]), na, nb, ng, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for r, (na, nb, ng, ls, sha) in zip(rows, docs, strict=True)]


@pytest.mark.parametrize(("block", "keep"), [(1 << 22, 1 << 18), (200, 20)])
def test_alignment_matches_plain_loops(spark, monkeypatch, block, keep):
    monkeypatch.setattr(tokenizer_alignment, "KEEP", keep)
    rows, docs = docs_of(spark, odd_texts(7))
    want = by_loops(rows)
    assert sum(w[1] == 0 and r[1] is not None and r[1] != "" for w, r in zip(want, rows, strict=True)) > 1  # some don't spell their text
    got = tokenizer_alignment.align_documents(docs, block=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(g[0]), *g[1:]) for g in got.collect()) == sorted(want)


def test_alignment_of_nothing(spark):
    assert tokenizer_alignment.align_documents(spark.createDataFrame([], DOCS)).collect() == []
    got = tokenizer_alignment.align_documents(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(g)[1:] for g in got) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_strings_are_encoded_alike_alone_and_within_texts():
    pair = tokenizer_alignment.Pair(*map(tokenizer_alignment.default_path, (tokenizer_alignment.TOKENIZER_A, tokenizer_alignment.TOKENIZER_B)))
    for text in odd_texts(3):
        cut = pair.split(text)
        assert "".join(cut) == " " + text
        assert [i for s in cut for i in pair.a.encode(s, add_special_tokens=False).ids] == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert list(itertools.chain(*pair._encode_b(cut))) == pair.b.encode(text) or not text


def test_last_step_gets_bounded_batches(spark, monkeypatch):
    """Blocks are large rows: however many a task has, a record batch holds no more than its bytes allow."""
    add_up = tokenizer_alignment._add_up

    def checked(parts):
        def one(part):
            if part.num_rows > 1:
                raise RuntimeError(f"{part.num_rows} blocks in one batch")
            return part

        return add_up(one(p) for p in parts)

    monkeypatch.setitem(common.STAGING, "spark.sql.execution.arrow.maxBytesPerBatch", "1000")
    texts = [f"word{i} and other{i} words" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, tokenizer_alignment.align_documents(docs, block=100).collect()))
    monkeypatch.setattr(tokenizer_alignment, "_add_up", checked)
    assert sorted(map(tuple, tokenizer_alignment.align_documents(docs, block=100).collect())) == want
    assert len(want) == 60
