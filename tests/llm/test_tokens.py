"""Byte-level BPE, alignment of two tokenizers, the conversation trie: against the libraries and plain Python."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillprint.llm import byte_bpe, conversation_trie, token_alignment

RANKS, JSON, PIECES = (P.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = ["The cat sat on the mat.", "", None, " ", "  two  blanks\t\ttabs\n\nlines ", "naïve façade Ærøskøbing über straße",
         "日本語のテキスト、空白なし", "a" * 5000, "x y " * 3000, "<|endoftext|> and <s> </s> <unk> <0x41>", "under▁line mark",
         "emoji 👩‍👩‍👧 zwj",
         " no-break em space　wide", "control \x00\x1c\x1f\x85 end", "it's we'll 've 'S 12345 ١٢٣ ½",
         "The cat sat on the mat.", "é combining ‍​", "tail blank ", "� replaced"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "aa", "s", len(x or "")) for i, x in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id here", None, None, None), (3, " ", None, None, 1)], DOCS)


def _reference(path=RANKS):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- byte-level BPE ---

def test_encoding_is_that_of_the_library(spark, docs):
    _, library = _reference()
    for row in byte_bpe.digest(docs, RANKS, P.PATTERN).collect():
        texts = [t for i, t in enumerate(TEXTS) if i == row.doc_id] or ["no id here"]
        ids = np.array(library.encode_ordinary(texts[0] or ""), "<u4")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256((texts[0] or "").encode()).hexdigest()


def test_another_vocabulary_and_every_kind_of_letter():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    _, library = _reference(path)
    with open(path, "rb") as file:
        tool = byte_bpe.Encoder(file.read(), P.PATTERN, remembered=50)
    texts = ["".join(f"a{chr(c)}b {chr(c)}1" for c in range(first, first + 512) if not 0xD800 <= c < 0xE000)
             for first in range(0, 0x11000, 512)]
    for text, ids in zip(texts, tool.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_a_token_that_merges_cannot_reach_is_still_found_whole():
    tokens = [bytes([i]) for i in range(256)] + [b"bc", b"ab", b"abc", b"xyz"]
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)},
                                special_tokens={})
    texts = ["abc", "xyz", "axyz", "abcabc", "bcab", ""]
    found = [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.Encoder(lines, P.PATTERN).encode(texts)]
    assert found == [library.encode_ordinary(x) for x in texts] and found[1] == [259]


def test_model_refuses_what_it_cannot_hold():
    with pytest.raises(ValueError, match="lacks"):
        byte_bpe.write_model([b"a"])
    with pytest.raises(ValueError, match="dense"):
        byte_bpe.read_ranks(b"YQ== 5")
    with pytest.raises(ValueError, match="No token"):
        with open(RANKS, "rb") as file:
            byte_bpe.Decoder(file.read()).decode(np.array([50256], "<u4").tobytes())


def test_columns_clash_empty_tables_and_round_trip(spark, docs):
    clash = docs.withColumn("token_ids", F.lit(1)).withColumn("Decoded", F.lit(2))
    rows = byte_bpe.decode(byte_bpe.encode(clash, RANKS, P.PATTERN), RANKS, into="bytes").collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].Decoded == 2
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in rows)
    assert byte_bpe.digest(docs.limit(0), RANKS, P.PATTERN).count() == 0


# --- alignment ---

def _bytes_of(a, b):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    for byte in range(256):
        if byte not in plain:
            letters[chr(256 + len(letters) - len(plain))] = byte
    return (lambda i: bytes(letters[c] for c in a.id_to_token(i)),
            lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


def _plain_alignment(rows):
    """Token by token and byte by byte."""
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    bytes_a, bytes_b = _bytes_of(a, b)
    count, made = collections.Counter(), []
    for key, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, x)) != want or b"".join(map(bytes_b, y)) != want:
            made.append((key, 0, 0, 0, [], ""))
            continue
        at_a = [i for i, t in enumerate(x) for _ in bytes_a(t)]
        at_b = [i for i, t in enumerate(y) for _ in bytes_b(t)]
        links = [(x[i], y[j]) for i, j in sorted(set(zip(at_a, at_b)))]
        count.update(links)
        ends = [k for k in range(len(at_a)) if k + 1 == len(at_a) or at_a[k] != at_a[k + 1] and at_b[k] != at_b[k + 1]]
        groups, s, u = [], 0, 0
        for k in ends:
            groups.append(",".join(map(str, x[s:at_a[k] + 1])) + "|" + ",".join(map(str, y[u:at_b[k] + 1])))
            s, u = at_a[k] + 1, at_b[k] + 1
        made.append((key, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(key, n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
             sha) for key, n_a, n_b, n_groups, links, sha in made]


def _order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_alignment_by_bytes(spark, docs):
    want = _plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    found = [tuple(r) for r in token_alignment.digest(docs, JSON, PIECES).collect()]
    assert _order(found) == _order(want)
    assert [r[1] for r in found if r[0] == 10] == [0]  # the mark of a space is not a space


def test_small_blocks_and_short_memory_give_the_same(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    want = _plain_alignment([(r.doc_id, r.text) for r in docs.collect()])
    made = token_alignment.blocks(docs, JSON, PIECES, block=20_000)
    assert made.count() > 10
    found = token_alignment.document_links(made, token_alignment.pair_counts(made))
    assert _order(map(tuple, found.collect())) == _order(want)


def test_windows_are_forgotten_between_blocks():
    with open(JSON, "rb") as first, open(PIECES, "rb") as second:
        tool = token_alignment.Tokenizers(first.read(), second.read(), remembered=3)
    for text in ["alpha beta gamma delta", "epsilon " + "z" * 500, "alpha beta", "under▁line", None]:
        made = token_alignment._pack(tool, [1], [text])
        want = _plain_alignment([(1, text)])[0]
        row = made["documents"][0]
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups_sha256"]) == (*want[1:5], want[7])


def test_words_encoded_in_a_row_are_those_encoded_alone():
    with open(JSON, "rb") as first, open(PIECES, "rb") as second:
        tool = token_alignment.Tokenizers(first.read(), second.read())
    words = [" the", " über", " 日本語", " <|endoftext|>", " it's", " a\n\nb", " under▁line", " 12345", " '", " s"]
    assert all(token_alignment.JOINS.fullmatch(w) for w in words)
    assert not any(token_alignment.JOINS.fullmatch(w) for w in ["  two", " end ", " ", " x\n", "bare"])
    sizes = np.array([len(w.encode()) for w in words])
    ids, ends = tool._joined(words, sizes)
    alone = [tool.a.encode(w, add_special_tokens=False).ids for w in words]
    assert [ids[s:e] for s, e in zip([0, *ends], ends)] == alone
    assert tool._joined(words, sizes + 1) == (None, None)


def test_no_letters_meet_across_a_cut():
    with open(JSON, "rb") as first, open(PIECES, "rb") as second:
        tool = token_alignment.Tokenizers(first.read(), second.read())
    assert tool.apart
    odd = [c for c in range(0x3100) if not chr(c).isalnum()]
    text = " ".join(f"a{chr(c)} {chr(c)}b c {chr(c)}" for c in odd)
    there, (ids_a, _), (ids_b, _) = tool.encode([text])
    assert ids_a.tolist() == tool.a.encode(" " + text, add_special_tokens=False).ids or not there[0]
    plain = " ".join(f"a{chr(c)} {chr(c)}b c {chr(c)}" for c in odd if c != 0x2581)
    there, (ids_a, _), (ids_b, _) = tool.encode([plain])
    assert there[0] and ids_b.tolist() == tool.b.encode(plain)
    assert ids_a.tolist() == tool.a.encode(" " + plain, add_special_tokens=False).ids


def test_empty_table_of_documents(spark, docs):
    assert token_alignment.digest(docs.limit(0), JSON, PIECES).count() == 0


# --- conversation trie ---

TURNS = "conv_id bigint, turn bigint, role string, text string, extra string"


def _plain_trie(rows):
    original = collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            original[conv].append(((turn is not None, turn or 0, key), (role, text)))
    original = {c: [x for _, x in sorted(v)] for c, v in original.items()}
    members, ended = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(original.get(c - c % 100, [])[:h] + original[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ended[turns].append(c)
    children = collections.Counter(x[:-1] for x in members if x)
    leaves, saved = collections.Counter(), collections.Counter()
    for x, convs in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not children[x]
            saved[x[:d]] += (len(convs) - 1) * len(x[-1][1] if x else "")
    return sorted((convs[0], len(x), members[x[:-1]][0] if x else -1, len(convs), children[x], leaves[x], saved[x],
                   hashlib.sha256(",".join(map(str, ended[x])).encode()).hexdigest()) for x, convs in members.items())


def _found(frame):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, frame.collect()))


def test_trie_of_odd_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(40), 100, 101, 102, 205, 299, 1000, 1007]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 13])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]),
                         rng.choice(["hi", "hi", "", None, "naïve 👋", "a" * 50]), "x"))
    rows += [(7, 1, "user", "hi", "x")] * 3 + [(None, 1, "user", "lost", "x")]
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    assert _found(conversation_trie.digest(frame)) == _plain_trie(rows)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(100 * c, t, "user", f"same {t}", "") for c in range(1, 60) for t in range(9)]
    rows += [(7, t, "user", f"long {t}", "") for t in range(150)] + [(107, t, "user", f"long {t}", "") for t in range(130)]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    assert _found(conversation_trie.digest(frame)) == _plain_trie(rows)


def test_many_ends_and_no_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("name"),
                                   F.col("id").alias("conv_id"))
    found = {bytes(r.name): r.ends_sha256 for r in conversation_trie.ends(rows.repartition(6)).collect()}
    for name, ids in ((b"a", [i for i in range(300) if i % 3 == 0]), (b"b", [i for i in range(300) if i % 3])):
        assert found[name] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert conversation_trie.digest(spark.createDataFrame([], TURNS)).count() == 0
