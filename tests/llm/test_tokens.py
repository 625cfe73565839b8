"""Alignment of tokenizers against a version that encodes and compares text by text."""

import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import align

if not os.path.exists(f"{align.FOLDER}/{align.BYTE_BPE}"):
    pytest.skip("no tokenizers here", allow_module_level=True)

FILES = tuple(open(f"{align.FOLDER}/{f}", "rb").read() for f in (align.BYTE_BPE, align.PIECE_BPE))


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_buffer(FILES[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_proto=FILES[1])


def plain(libraries, text):
    """Token ids, cuts, written groups and links of one text, by whole-text encoding."""
    a, b = libraries
    chars = align._byte_level()
    whole = (" " + text).encode() if text else b""
    first, second = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
    a_bytes = [bytes(chars[c] for c in a.id_to_token(i)) for i in first]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in second)]
    if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return 0, 0, "", []
    a_end, b_end = (np.cumsum([len(x) for x in own]).tolist() for own in (a_bytes, b_bytes))
    groups, links, low = [], [], 0
    for cut in sorted(set(a_end) & set(b_end)):
        own = [[t for t, e in zip(ids, ends) if low < e <= cut] for ids, ends in ((first, a_end), (second, b_end))]
        groups.append("|".join(",".join(map(str, x)) for x in own))
        links.append((own[0][-1], own[1][-1]))
        low = cut
    return len(first), len(second), ";".join(groups), links


def texts(n=150):
    rng = random.Random(4)
    odd = [*"ab e  \n\t\r.,'1x", "é", "中", " ", " ", "'s", "\x1c", "᠎", "​", "😀", "don't", "<|endoftext|>", "<s>", "</s>", "\x00", "é"]
    out = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return [*out, "", None, " ", "   ", "a ", " a", "\n", "a▁b", "▁", "same text", "same text", "word " * 3000, "中文" * 2000, "x" * 5000, " " * 3000]


def wanted(libraries, rows):
    found = [plain(libraries, t) for t in rows]
    counts = Counter(p for f in found for p in f[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(i, a, b, len(g), len(g), sum(counts[p] == most[p[1]] for p in g), sum(counts[p] for p in g), hashlib.sha256(s.encode()).hexdigest() if g else "") for i, (a, b, s, g) in enumerate(found)]


@pytest.mark.parametrize("common", [align.COMMON, 5, 1])
def test_alignment_equals_whole_texts(spark, libraries, common):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash", 1, [1]) for i, t in enumerate(rows)], "doc_id long, text string, rare string, n_a int, pairs array<int>").repartition(3)
    got = align.alignment(docs, common=common).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == wanted(libraries, rows)


def test_repeated_rows_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, align.alignment(docs).collect()), key=repr)
    assert [r[0] for r in got] == [1, 1, None, None] and got[0] == got[1] and got[0][1:] in (got[2][1:], got[3][1:])
    assert align.alignment(docs.limit(0)).collect() == []


def test_long_texts_go_in_pieces(libraries, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    text = "".join(rng.choice(["word ", "a\n ", "  ", "end.\n", "中 ", "x"]) for _ in range(400))
    monkeypatch.setattr(align, "BLOCK", 50)
    pieces = align.pieces_of(text, 50)
    assert len(pieces) > 10 and " ".join(pieces) == text
    own = align.coder(FILES)
    runs = list(align._runs(pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [text.encode(), (text + " ▁").encode()]}), own))
    assert {r for rows, _ in runs for r in rows} == {0}
    found = [align.align(own, pieces) for _, pieces in runs]
    assert ";".join(bytes(f.groups(i)[:-1]).decode() for f in found for i in range(len(f.n_a))) == plain(libraries, text)[2]


def test_other_byte_level_files_are_encoded_by_their_library(libraries):
    held = json.loads(FILES[0])
    held["pre_tokenizer"]["add_prefix_space"] = True
    encode, tokens = align._byte_bpe(json.dumps(held).encode())
    fast, same = align._byte_bpe(FILES[0])
    assert tokens == same
    for text in [" one two  three\n\n four's <|endoftext|>", " " + "z" * 300]:
        assert encode(text) == fast(text) == libraries[0].encode(text, add_special_tokens=False).ids
