"""A task leaves its Python worker as it found it."""

import gc

import pyarrow as pa
import pytest

from barspark.llm import packing, subwords
from barspark.llm.queries import public_tokenizer


class Frame:
    """Stands for a DataFrame and runs what mapInArrow gets in this process."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        batch = pa.RecordBatch.from_pydict({"row": [0, 1], "doc_id": [1, 2], "text": ["some words here", None]})
        return list(run(iter([batch])))


@pytest.mark.parametrize("job", [
    lambda: packing.tokenised(Frame(), public_tokenizer("word_bpe_49k.json")),
    lambda: subwords.token_counts(Frame(), public_tokenizer("piece_bpe_32k.model")),
    lambda: subwords.n_best(Frame(), public_tokenizer("piece_bpe_32k.model")),
])
def test_the_collector_is_on_again(spark, job):
    assert gc.isenabled()
    try:
        assert job()
        assert gc.isenabled()
    finally:
        gc.enable()
