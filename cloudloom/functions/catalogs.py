"""Standard sections and plates."""

from __future__ import annotations

# Heights and widths of standard rolled and hollow sections, millimetres.
IPE = {80: (80, 46), 100: (100, 55), 120: (120, 64), 140: (140, 73), 160: (160, 82), 180: (180, 91), 200: (200, 100), 220: (220, 110), 240: (240, 120),
       270: (270, 135), 300: (300, 150), 330: (330, 160), 360: (360, 170), 400: (400, 180), 450: (450, 190), 500: (500, 200), 550: (550, 210), 600: (600, 220)}
HEA = {100: (96, 100), 120: (114, 120), 140: (133, 140), 160: (152, 160), 180: (171, 180), 200: (190, 200), 220: (210, 220), 240: (230, 240), 260: (250, 260),
       280: (270, 280), 300: (290, 300), 320: (310, 300), 340: (330, 300), 360: (350, 300), 400: (390, 300), 450: (440, 300), 500: (490, 300), 600: (590, 300)}
UPN = {80: 45, 100: 50, 120: 55, 140: 60, 160: 65, 180: 70, 200: 75, 220: 80, 240: 85, 260: 90, 280: 95, 300: 100}
SHS = (40, 50, 60, 70, 80, 90, 100, 120, 140, 150, 160, 180, 200, 250)
RHS = ((50, 30), (60, 40), (80, 40), (100, 50), (100, 60), (120, 60), (120, 80), (140, 80), (160, 80), (200, 100), (200, 120), (250, 150), (300, 200))
ANGLES = (40, 50, 60, 70, 80, 90, 100, 120, 150)
# Stock plate thicknesses, millimetres; density of steel, kg/m^3.
PLATES = (2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30)
STEEL = 7850.0


def sections() -> list[tuple[str, str, float, float]]:
    """family, name, height, width in metres; HEB sections are as high as their name, and as wide up to 300."""
    rows = [("I", f"IPE {k}", h, b) for k, (h, b) in IPE.items()] + [("H", f"HEA {k}", h, b) for k, (h, b) in HEA.items()]
    rows += [("H", f"HEB {k}", k, min(k, 300)) for k in HEA] + [("U", f"UPN {k}", k, b) for k, b in UPN.items()]
    rows += [("hollow", f"SHS {k}", k, k) for k in SHS] + [("hollow", f"RHS {h}x{b}", h, b) for h, b in RHS] + [("L", f"L {k}x{k}", k, k) for k in ANGLES]
    return [(f, n, h / 1000, b / 1000) for f, n, h, b in rows]


def stock() -> list[float]:
    """Plate thicknesses in metres."""
    return [t / 1000 for t in PLATES]
