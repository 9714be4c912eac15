"""Logger exports with planted faults, written by the tests themselves."""

from __future__ import annotations

import datetime as dt
import math
import os

HEADER = ["計測日時", "DC_KW", "AC_KW", "PF", "TEMP_INV", "IRR", "STATUS"]
UNITS = ["", "kW", "kW", "-", "℃", "W/m2", ""]
ROWS = 1440


def minute_rows(unit, day):
    """Unit 3 at 72 % and out for rows 600-719; unit 2 stuck at 31.4 in rows 400-520; unit 1 without rows 800-859."""
    start = dt.datetime.fromisoformat(day)
    scale = {1: 1.0, 2: 0.985, 3: 0.72}[unit]
    for i in range(ROWS):
        if unit == 1 and 800 <= i < 860:
            continue
        irr = max(0.0, 1000 * math.sin(math.pi * (i - 300) / 840)) if 300 < i < 1140 else 0.0
        irr = round(irr, 1)
        dc = round(irr * 2.2 * scale, 2)
        if unit == 3 and 600 <= i < 720:
            dc = 0.0
        temp = 31.4 if unit == 2 and 400 <= i <= 520 else round(24 + irr / 50 + (i % 7) * 0.1, 2)
        pf = "-" if i < 3 else ("0.99" if dc > 0 else "0.0")
        yield [(start + dt.timedelta(minutes=i)).strftime("%Y/%m/%d %H:%M"), dc, round(dc * 0.985, 3), pf, temp, irr,
               "運転" if dc > 0 else "停止"]


def write_units(folder, days=("2026-08-06", "2026-08-07"), encoding="cp932"):
    os.makedirs(folder, exist_ok=True)
    for unit in (1, 2, 3):
        for day in days:
            lines = ["PCS監視データ出力", f"出力日時,{day}", "", ",".join(HEADER), ",".join(UNITS)]
            lines += [",".join(str(c) for c in row) for row in minute_rows(unit, day)]
            with open(f"{folder}/{unit:03d}_PCS監視_{day}.csv", "wb") as f:
                f.write(("\r\n".join(lines) + "\r\n").encode(encoding))


def write_text(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path
