import io
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard

from faultbench.llm.queries import op12_seekable_frames
from faultbench.llm.seekable import FrameFile, FrameWriter, manifest, read_documents, read_tokens, write_tokens

from awkward import documents, text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def made(docs):
    out = Memory()
    writer = FrameWriter(out)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    return out


def some():
    rng = np.random.default_rng(12)
    sizes = [0, 1, 3_000_000, 5, 700, 0, 40]
    ids = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in sizes]
    return list(zip([None, None, -5, 3, 3, 3, 2**62], ids))


def test_round_trip_and_single_documents():
    docs = some()
    file = FrameFile.open(made(docs))
    assert list(file.read_all()) == [ids for _, ids in docs]
    assert [file.read(i) for i in range(7)] == [ids for _, ids in docs]
    assert (list(file.find(3)), list(file.find(-5)), list(file.find(2**62)), list(file.find(0))) == ([3, 4, 5], [2], [6], [])
    assert file.null.tolist() == [True, True, *[False] * 5]
    empty = FrameFile.open(made([]))
    assert list(empty.read_all()) == [] and list(empty.find(1)) == []


def test_any_decoder_reads_the_file_through():
    docs = some()
    data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(made(docs).getvalue()), read_across_frames=True).read()
    assert data == b"".join(ids for _, ids in docs)


def test_seek_table_is_that_of_the_public_format():
    docs = some()[2:]
    data = made(docs).getvalue()
    frames, flags, magic = np.frombuffer(data[-9:-5], "<u4")[0], data[-5], np.frombuffer(data[-4:], "<u4")[0]
    assert (frames, flags, magic) == (len(docs) + 1, 0x80, 0x8F92EAB1)
    begin = len(data) - 9 - 12 * int(frames) - 8
    assert np.frombuffer(data[begin : begin + 8], "<u4").tolist() == [0x184D2A5E, 12 * int(frames) + 9]
    table = np.frombuffer(data[begin + 8 : -9], "<u4").reshape(-1, 3)
    at = 0
    for (_, ids), (packed, size, check) in zip(docs, table.tolist()):
        assert zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=max(1, size)) == ids
        assert (size, check) == (len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        at += packed
    assert at + table[-1][0] == begin and table[-1][1] == 0


def test_damage_is_found_and_only_in_its_frame():
    docs = some()
    good = FrameFile.open(made(docs))
    data = bytearray(made(docs).getvalue())
    data[int(good.begins[2]) + 5000] ^= 1
    hurt = FrameFile.open(Memory(bytes(data)))
    assert [hurt.read(i) for i in (1, 3, 4, 6)] == [docs[i][1] for i in (1, 3, 4, 6)]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        hurt.read(2)
    with pytest.raises(ValueError):
        FrameFile.open(Memory(bytes(data[:-1])))


def test_one_document_is_fetched_alone():
    class Counted(Memory):
        fetched = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.fetched += len(got)
            return got

    docs = [(i, random.Random(i).randbytes(4000)) for i in range(500)]
    file = FrameFile.open(Counted(made(docs).getvalue()))
    Counted.fetched = 0
    assert file.read(file.find(321)[0]) == docs[321][1]
    assert Counted.fetched < 4200


def want(rows):
    tok, at, out = tokenizers.Tokenizer.from_file(PATH), 0, []
    for d, t in rows:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("partitions", [1, 6])
def test_awkward_rows(spark, tmp_path, partitions):
    folder = f"file://{tmp_path}/made"
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 1).lower())
    try:
        files = write_tokens(documents(spark), PATH, folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert files.count() > 1 or partitions == 1
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in read_tokens(spark, folder).collect()]
    rows = sorted(text(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(got, key=lambda r: r[1]) == want(rows)
    own = [(r.doc_id, r.start) for r in read_documents(spark, folder, [5, 2**62, 77, 5]).collect()]
    assert sorted(own) == sorted((d, s) for d, s, _, _ in got if d in (5, 2**62))


def test_empty_table(spark, tmp_path):
    assert write_tokens(documents(spark, []), PATH, str(tmp_path / "none")).collect() == []
    assert read_tokens(spark, str(tmp_path / "none")).collect() == []
    assert manifest(spark, str(tmp_path / "none")).count() == 0


def test_query_equals_the_library(spark):
    got = op12_seekable_frames(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert sorted(map(tuple, got)) == want([(r.doc_id, r.text or "") for r in docs])
