"""Queries against their SQL on tables made to hit bytes where a rounding decides."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from rasterloom import catalog
from rasterloom.plans import process


def both(spark, name, vectors, folder):
    """The rows of a query and of its SQL, over embeddings whose bytes are given (64 each)."""
    embeddings = [np.float32((v.astype(float) + 0.5) / 127.5 - 1) for v in vectors]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array([list(e) for e in embeddings], pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    return sorted(map(tuple, catalog.QUERIES[name](spark, str(folder)).select(*want.columns).collect())), sorted(want.fetchall())


#: (r, g, b) of which the published matrix and the product of the profiles make different bytes.
APART = [(0, 55, 8), (3, 89, 75), (3, 219, 47), (5, 196, 184), (7, 237, 190), (9, 255, 197), (11, 168, 30), (13, 54, 243)]


def test_profile_convert_where_the_seventh_place_decides(spark, tmp_path):
    r, g, b = np.resize(np.array(APART), (64, 3)).T
    got, want = both(spark, "profile_convert", [b, g, r], tmp_path)
    assert len(want) == 64 and got == want


#: An 8x8 image of which one pixel of the 4x4 thumbnail is an exact half, or so near that single precision takes the wrong side.
HALF = bytes.fromhex(
    "29dfc604f733ee0d796df79148b8f1a81751a9f7614993ede6ce4309b6176fc3"
    "a0f14c5cfa76fcbe9fe8ccc034108c119d8a762e704b0c82dffcb4c2ab090704"
)


def test_thumbnail_batch_where_a_half_decides(spark, tmp_path):
    got, want = both(spark, "thumbnail_batch", [np.frombuffer(HALF, np.uint8)], tmp_path)
    assert len(want) == 16 and got == want


def test_scale_is_exact():
    """The weights of 8 to 4 are whole 256ths, so whole numbers say what is right. Seen through alpha, and with rows past one strip, it is the same."""
    k = np.rint(process._kernel(8, 4, "catmullrom") * 256).astype(int)
    assert (k == process._kernel(8, 4, "catmullrom") * 256).all()
    px = np.random.default_rng(3).integers(0, 256, (4000, 8, 8), dtype=np.uint8)
    px = np.concatenate([px, np.frombuffer(HALF, np.uint8).reshape(1, 8, 8)])
    want = np.clip((k @ px.astype(int) @ k.T + (1 << 15)) >> 16, 0, 255)
    assert (np.stack([process.scale(x[..., None], 4, 4)[..., 0] for x in px]) == want).all()
    solid = np.concatenate([np.repeat(px[..., None], 3, 3), np.full((*px.shape, 1), 255, np.uint8)], 3)
    got = np.stack([process.scale(x, 4, 4) for x in solid])
    assert (got[..., :3] == want[..., None]).all() and (got[..., 3] == 255).all()
    wide = np.concatenate(list(px[:75]), 1)[..., None]
    assert (process.scale(wide, wide.shape[1], 4)[..., 0] == np.clip((k @ wide[..., 0].astype(int) + 128) >> 8, 0, 255)).all()
