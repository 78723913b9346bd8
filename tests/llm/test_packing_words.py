"""Words of plain letters and marks are encoded by the tokenizer's model alone, with the ids of the whole tokenizer."""

from tokenizers import Tokenizer

from barspark.llm import packing
from barspark.llm.queries import public_tokenizer

TEXTS = ["One two, three!!", "don't it's A'", "a_b `c` ~~ ]]> #$%", "É!é' Ünï_÷× ß", "x" * 80 + " y", "", "  double  blank\n\n", "42nd (076) 日本 語!", "!é? ...word"]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_plain_parts_go_to_the_model(monkeypatch):
    path = public_tokenizer("word_bpe_49k.json")
    ids, whole = packing.WordIds(path), Tokenizer.from_file(path)
    ids.tokenizer = Counted(ids.tokenizer)
    monkeypatch.setattr(packing, "word_ids", lambda _: ids)
    got = packing.token_bytes(path, TEXTS)
    want = [packing.np.array([*whole.encode(t, add_special_tokens=False).ids, packing.END], packing.np.uint32).tobytes() for t in TEXTS]
    assert got == want
    words = {w for t in ids.tokenizer.given for w in t.split(" ")}
    assert "ß" in words and not words & {"one", "two", "three", "!!", ",", "don"}
