import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryfield.llm.encoders import encoder, slices, tokenizer_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = ["word", "Don't", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "é", "é", "İ", "ΑΣ", "ß", "123", "½", "<|endoftext|>", "<|", "!!", "…", "日本", "🙂", "'s", " 's", "", "\r\n", "​", "\x00", "²", "ǅ", "ª", "x" * 300]


def whole(name, text):
    return np.asarray(encoder(tokenizer_path(name)).tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=12), free=st.text(max_size=12), plain=st.text(st.characters(max_codepoint=0x24F), max_size=30))
def test_pieces_give_the_ids_of_the_whole(name, parts, free, plain):
    texts = ["".join(parts), " ".join(parts), free, free + " " + "".join(parts), plain, plain + "".join(parts)]
    assert encoder(tokenizer_path(name)).batch(texts) == [whole(name, t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_every_plain_character(name):
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x24F + 1)]
    assert encoder(tokenizer_path(name)).batch(texts) == [whole(name, t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_long_pieces(name):
    texts = ["x" * 50_000, " " * 5000 + "a", "ab " * 3000 + "y" * 3000 + " end", "!?" * 4000, ""]
    assert encoder(tokenizer_path(name)).batch(texts) == [whole(name, t) for t in texts]


def test_slices_hold_the_strings_of_one_part():
    ids, texts = list(range(1000)), [f"{i} " * (i % 7) * 2000 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])
    parts = list(slices(batch, 64, 1 << 18))
    assert [i for p, _ in parts for i in p] == ids and [t for _, p in parts for t in p] == texts
    assert all(len(p) <= 64 and sum(map(len, p[:-1])) < 1 << 18 for _, p in parts)
    assert list(slices(batch.slice(0, 0))) == []
    tracemalloc.start()
    for _ in slices(batch, 64, 1 << 18):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 21, (peak, sum(map(len, texts)))
