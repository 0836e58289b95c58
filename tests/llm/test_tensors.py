"""The media query hands out whole RGB tensors."""

import hashlib

import numpy as np

from graphwarden.llm import media

TEXTS = ["a short text", "", None, "ñandú 日本語 " * 300, "x" * 192]


def waves():
    """Basis of the 8 x 8 cosine transform."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)


#: Zigzag order: where a block's k-th coefficient is.
ZIGZAG = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


def test_tensors(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in media.decode(media.encode(docs), tensors=True).collect()}
    report = {r.doc_id: r for r in media.report(docs).collect()}
    for i, r in rows.items():
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert media.feature(rgb) == r.feature
        assert (report[i].rgb_bytes, report[i].rgb_sha256) == (rgb.size, hashlib.sha256(r.rgb).hexdigest())
        assert r.width == 8 and rgb.size == len(r.payload)
        # the tensor is the inverse transform of the payload's coefficients, b + 2 each
        c, b = np.frombuffer(r.payload, np.uint8).reshape(-1, 3, 64) + 2.0, waves()
        both = []
        for order in ([u * 8 + v for u, v in ZIGZAG], list(range(64))):
            blocks = np.zeros(c.shape)
            blocks[..., order] = c
            y, cb, cr = np.moveaxis(np.clip(np.round(b.T @ blocks.reshape(-1, 3, 8, 8) @ b + 128), 0, 255), 1, 0)
            want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1).clip(0, 255).reshape(rgb.shape)
            both.append(np.abs(want - rgb).max())
        assert min(both) <= 3
