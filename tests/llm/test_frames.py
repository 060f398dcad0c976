"""Baseline frames of other writers: detail inside the blocks, other tables, quantisers and restarts."""
import random
import struct

import numpy as np

from gridfold.llm import media as M

DC = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
AC = bytes([0] * 7 + [162] + [0] * 8) + bytes([0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)])


def frame(blocks, quantiser, restart):
    """A frame of coefficient blocks (n x 64, zigzag order)."""
    dc, ac = M._codes(DC[:16], DC[16:]), M._codes(AC[:16], AC[16:])
    out = b""
    for start in range(0, len(blocks), restart):
        bits, level = "", 0

        def put(table, symbol, value, size):
            code, n = table[symbol]
            return format(code, f"0{n}b") + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "")
        for b in blocks[start:start + restart]:
            size = abs(int(b[0]) - level).bit_length()
            bits += put(dc, size, int(b[0]) - level, size)
            level, run = int(b[0]), 0
            for v in b[1:np.flatnonzero(b)[-1] + 1 if b.any() else 1].tolist():
                if v == 0:
                    run += 1
                    continue
                bits += put(ac, 0xF0, 0, 0) * (run // 16) + put(ac, run % 16 << 4 | abs(v).bit_length(), v, abs(v).bit_length())
                run = 0
            bits += put(ac, 0, 0, 0) if not b[63] else ""
        bits += "1" * (-len(bits) % 8)
        last = start + restart >= len(blocks)
        out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") + bytes([0xFF, 0xD9 if last else 0xD0 + start // restart % 8])
    seg = M._segment
    return b"".join([b"\xff\xd8", seg(0xDB, b"\x00" + bytes(quantiser)), seg(0xC0, struct.pack(">BHHBBBB", 8, M.ROWS * 8, M.ACROSS * 8, 1, 1, 0x11, 0)),
                     seg(0xC4, b"\x00" + DC + b"\x10" + AC), seg(0xDD, struct.pack(">H", restart)), seg(0xDA, b"\x01\x01\x00\x00\x3f\x00"), out])


def test_frames_with_detail_beside_plain_ones():
    dice = random.Random(3)
    want = np.array([dice.randrange(60, 196) for _ in range(512)], np.uint8)
    blocks = np.zeros((512, 64), np.int64)
    blocks[:, 0] = (want.astype(np.int64) - 128) * 2
    for b in blocks:
        for k in dice.sample(range(1, 64), 3):
            b[k] = dice.choice([-5, -2, 1, 4])
    plain = bytes(dice.randrange(256) for _ in range(512))
    files = [*M.write_videos([plain]), M.wrap([frame(blocks, [4] + [3] * 63, 40)], 500), *M.write_videos([plain[::-1]])]
    got = M.read_videos(files)
    assert got[0][0].tobytes() == plain and got[2][0].tobytes() == plain[::-1]
    assert got[1][0].tobytes() == want.tobytes()[:500]
    assert M.read_videos([M.wrap([frame(blocks, [4] + [3] * 63, 40)[:-900]], 500)]) == [None]


def test_zigzag_begins_as_in_the_standard():
    assert M.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(M.ZIGZAG) == list(range(64))
