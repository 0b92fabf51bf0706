"""Word lattices for scripts without spaces.

The dictionary is the words of those scripts in a public tokenizer's vocabulary, with its ranks as their weights, and the
function words below. The words beside a gap are those of the lightest path through the lattice of a window next to it.
"""

from __future__ import annotations

import base64
import math
import re
from functools import cache, lru_cache

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WINDOW = 24  # characters beside a gap; longer words than half of it aren't in the dictionary
_LETTERS = re.compile(r"[\u0e00-\u0e7f]+|[\u3040-ヿ㐀-鿿豈-\ufaff]+")
#: Words that a vocabulary of pieces may lack.
_FUNCTION = "และ หรือ ที่ ซึ่ง อัน ของ ใน จาก โดย กับ แก่ ต่อ เพื่อ เพราะ แต่ แต่ว่า ว่า ให้ ถึง จน ๆ ฯ ฯลฯ คน รายการ ล้าน บาท ดอลลาร์ เปอร์เซ็นต์ ร้อยละ คือ เช่น ได้แก่ คุณ นาย นาง นางสาว บริษัท บริษัทฯ ประมาณ ราว ครับ ค่ะ คะ นะ แล้ว เลย ไหม มั้ย หรอ เถอะ สิ ซิ จ้ะ จ๊ะ ด้วย อย่างไรก็ตาม นอกจากนี้ ดังนั้น ทั้งนี้ ต่อมา โดยสรุป คณะกรรมการ พนักงาน ลูกค้า รายได้ ต้นทุน อัตรา สินค้า ผู้สอบบัญชี ฝ่ายจัดการ ความผันผวน ภาพรวม เอกสาร กำหนด ทันกำหนด ในปีนี้ ปีนี้ เป็นครั้งแรก กรรมการ ราคาตลาด คำสั่งซื้อ ต่ออายุ หนังสือ คงเหลือ กำไร と って という といった との とは とも として などと っ 表示 说 称 指出"


@cache
def dictionary(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Words and their weights (the lighter the likelier)."""
    import public_tokenizers as P

    out: dict[str, float] = {}
    with open(vocabulary if "/" in vocabulary else P.path(vocabulary), "rb") as f:
        for a, b in map(bytes.split, f):
            try:
                w = base64.b64decode(a).decode().strip()
            except UnicodeDecodeError:
                continue
            if 1 < len(w) <= WINDOW // 2 and _LETTERS.fullmatch(w):
                out.setdefault(w, 6 + math.log(2 + int(b)))
    for w in _FUNCTION.split():
        out[w] = 6.0
    return out


UNKNOWN = 14.0  # the weight of a letter that no word covers


@lru_cache(1 << 16)
def lattice(run: str) -> tuple[str, ...]:
    """The words of the lightest path through run; letters that no word covers stand alone."""
    words = dictionary()
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        weight, at = best[end - 1][0] + UNKNOWN, end - 1
        for a in range(max(0, end - WINDOW // 2), end):
            if (w := words.get(run[a:end])) is not None and best[a][0] + w < weight:
                weight, at = best[a][0] + w, a
        best.append((weight, at))
    out, end = [], len(run)
    while end:
        out.append(run[best[end][1] : end])
        end = best[end][1]
    return tuple(reversed(out))


def first(p: str, at: int) -> str:
    """The first word of the letters at at, or nothing."""
    m = _LETTERS.match(p, at, at + WINDOW)
    return lattice(m[0])[0] if m else ""


def last(p: str, end: int) -> str:
    """The last word of the letters that end at end, or nothing."""
    a = end
    while a > max(0, end - WINDOW) and _LETTERS.match(p[a - 1]):
        a -= 1
    return lattice(p[a:end])[-1] if a < end else ""
