import hashlib
import random

import public_tokenizers
import sentencepiece
from runledger.llm.merging import PairTable, merge
from runledger.llm.piece_spans import Normalizer, encode_pieces, encoder, op5_pieces, piece_digests
from runledger.llm.token_counts import counter, op2_token_counts, token_counts
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a ", "a" * 20_000, "ab" * 3000, "<|endoftext|>x<|endoftext|><|endoftext|>", " \n\t  　 x", "'ll'LL 're" * 20, "%%%%%%$$$" * 99,
    "日本語" * 500, "\x1c\x1d\x85 a", "\x00a\x00", "▁▁a▁", "😀😀é ß", "   " * 200 + "z", "th" * 900, "<s> </s> <unk> [INST]",
]


def mixtures(n, seed):
    pick = random.Random(seed)
    parts = ["a", "b", " ", "th", "e", "\n", "é", "日", "!", "1", "23", "'s", "  ", " ", "😀", "t", "h", "he", "tht", "▁", "\t"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(1, 50))) for _ in range(n)]


def test_merging_in_rounds_equals_merging_one_by_one():
    pick = random.Random(1)
    pairs = {}
    while len(pairs) < 30:
        pairs.setdefault((pick.randrange(12), pick.randrange(12)), len(pairs))
    table = PairTable([a for a, _ in pairs], [b for _, b in pairs], range(30), [12 + r for r in range(30)])

    def plain(seq):
        seq = list(seq)
        while found := [(pairs[p], i) for i, p in enumerate(zip(seq, seq[1:])) if p in pairs]:
            rank, i = min(found)
            seq[i : i + 2] = [12 + rank]
        return seq

    sequences = [[pick.randrange(12) for _ in range(pick.randint(1, 25))] for _ in range(200)] + [[]]
    for leftmost in (False, True):
        symbols, sizes = merge([x for s in sequences for x in s], [len(s) for s in sequences], table, leftmost)
        at = 0
        for s, size in zip(sequences, sizes):
            assert symbols[at : at + size].tolist() == plain(s)
            at += size


def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(BPE)
    whole = [*texts.values(), *ODD, *mixtures(1500, 2)]
    assert counter(BPE).count(whole) == [len(x.ids) for x in library.encode_batch(whole, add_special_tokens=False)]


def test_every_character_splits_as_in_the_library():
    library = Tokenizer.from_file(BPE)
    samples = [f"a{c}b {c}1{c}{c} ?{c} \n{c} " for c in map(chr, [*range(0x3100), *range(0xA000, 0xD800, 37), *range(0xE000, 0x11000, 5), *range(0x1F000, 0x1FB00, 3)])]
    assert counter(BPE).count(samples) == [len(x.ids) for x in library.encode_batch(samples, add_special_tokens=False)]


def test_query_rows(spark, texts, make):
    rows = {r["doc_id"]: r for r in op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    library = Tokenizer.from_file(BPE)
    for i, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert tuple(rows[i]) == (i, len(text.encode()), n, n > 1024)
    odd = token_counts(make([(1, None), (None, "x"), (2, "a b"), (2, "a b"), (3, "")]), BPE).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in odd) == [
        ("1", 0, 0, False), ("2", 3, 2, False), ("2", 3, 2, False), ("3", 0, 0, False), ("None", 1, 1, False),
    ]
    assert token_counts(make([]), BPE).collect() == []


def test_pieces_equal_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    whole = [*texts.values(), *ODD, *mixtures(2500, 3)]
    assert [ids.tolist() for ids, _ in encoder(PIECES).encode(whole)] == library.encode(whole)


def test_spans_cover_the_text_and_equal_the_librarys_surfaces(texts):
    library, tool = sentencepiece.SentencePieceProcessor(model_file=PIECES), encoder(PIECES)
    for text in [*list(texts.values())[:40], *[t for t in ODD if len(t) < 3000], *mixtures(200, 4)]:
        if not text:
            continue
        ((ids, origin),) = tool.encode([text])
        begins, ends = tool.spans(ids, origin)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        if "\x00" not in text:
            surfaces = [p.surface for p in library.encode(text, return_type="proto").pieces]
            assert [raw[a:b].decode() for a, b in zip(begins, ends)] == surfaces


def test_compiled_maps_normalise_as_in_the_library():
    samples = ["  Ｈｅｌｌｏ  ①２ﬁ  ½ 　 x​ y  ", "ｶﾞｷﾞ", "é", " \t\n a", "①", "plain words", "   ", "a  b", "㌀㍿ ǆ"]
    for rule in ("nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"):
        for squeeze in (True, False):
            library = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze)
            model = sentencepiece_model_pb2.ModelProto()
            model.ParseFromString(library.serialized_model_proto())
            own = Normalizer(model.normalizer_spec)
            for text in samples:
                data, origin = own(text.encode())
                expected, offsets = library.normalize(text, with_offsets=True)
                assert data.decode() == expected, (rule, squeeze, text)
                if not expected:
                    continue
                # The library counts characters on both sides.
                starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
                assert [len(text.encode()[: origin[i]].decode()) for i in [*starts, len(data)]] == offsets


def test_piece_query(spark, texts, make):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in op5_pieces(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r["doc_id"]])
        expected = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len(texts[r["doc_id"]].encode()))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["covered_bytes"]) == expected
    odd = piece_digests(make([(1, None), (2, ""), (None, "x"), (None, "x")]), PIECES).collect()
    assert [(r["n_tokens"], r["ids_sha256"]) for r in odd if r["doc_id"]] == [(0, sha(""))] * 2 and len(odd) == 4
    assert piece_digests(make([]), PIECES).collect() == []
    (row,) = encode_pieces(make([(7, "Hello  wörld 😀")]), PIECES).collect()
    assert row["ids"] == library.encode("Hello  wörld 😀") and row["begins"][0] == 0 and row["ends"][-1] == len("Hello  wörld 😀".encode())
