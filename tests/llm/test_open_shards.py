"""Token-id files asked without being expanded: answers against the ids, and how many bytes are read."""

import io

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalmill.llm import wavelet


class Counted(io.BytesIO):
    asked = 0

    def read(self, *n):
        out = super().read(*n)
        self.asked += len(out)
        return out


def shard(n, width=16, seed=1):
    ids = np.random.default_rng(seed).integers(0, 1 << width, n).astype(np.uint16)
    ids[:: 1000] = 7
    return ids, wavelet.packed(ids, [5], np.array([n]), width)


@pytest.mark.parametrize("n", [0, 1, 4096, 8 * wavelet.PIECE, 8 * wavelet.PIECE + 1, 300_001])
def test_open_file_answers(n):
    ids, content = shard(n)
    m = wavelet.ShardFile(io.BytesIO(content))
    rng = np.random.default_rng(n)
    for i in rng.integers(0, n, 20).tolist() if n else ():
        assert m.access(i) == ids[i]
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(7, a, b) == (ids[a:b] == 7).sum() and m.count(int(ids[i])) == (ids == ids[i]).sum()
    where = np.flatnonzero(ids == 7).tolist()
    for k in {0, len(where) // 2, len(where) - 1} if where else ():
        assert m.occurrence(7, k) == where[k]
    for wrong in (lambda: m.access(n), lambda: m.access(-1), lambda: m.occurrence(7, len(where))):
        with pytest.raises(IndexError):
            wrong()
    assert (m.ids() == ids).all() and m.documents()[0] == [5]


def test_answers_read_few_bytes():
    ids, content = shard(1 << 21)
    for ask, pieces in ((lambda m: m.access(1_234_567), 1), (lambda m: m.count(7, 1000, 2_000_000), 2), (lambda m: m.occurrence(7, 1000), 3)):
        f = Counted(content)
        m = wavelet.ShardFile(f)
        ask(m)
        head = 4 * (3 + 16 + 16 * 16) + 28
        counts = 16 * 4 * ((1 << 21) // wavelet.BLOCK + 1)
        # of each plane its counts and the pieces at the ends of a range, with what zstd adds to bits it can't press
        assert f.asked < head + counts + 16 * pieces * (wavelet.PIECE + 64) + 500
        assert f.asked < len(content) * pieces / 10


def test_other_files_are_refused():
    _, content = shard(10)
    for bad in (b"", b"SMWVM01\n" + content[8:], content[:20] + b"\1\0\0\0" + content[24:]):
        with pytest.raises(ValueError):
            wavelet.ShardFile(io.BytesIO(bad))


def test_tokens_counted_over_all_files(spark, tmp_path):
    words = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(words)
    texts = ["the cat and the dog", "", None, "of the of the of", "nothing here " * 400, "the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = wavelet.write_shards(docs, words, f"file://{tmp_path}/shards", end_id=1, shard_ids=100)
    encoded = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    asked = [1, 2, *library.encode("the of nothing", add_special_tokens=False).ids]
    out = {r.token: (r.n_docs, r.n) for r in wavelet.token_counts(manifest, asked).collect()}
    assert out == {t: (sum(t in e for e in encoded), sum(e.count(t) for e in encoded)) for t in asked}
    assert wavelet.token_counts(manifest.limit(0), asked).count() == 0
