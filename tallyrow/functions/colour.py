"""Colour arithmetic as column expressions."""

from tallyrow.plans.query import Query

# Colours of parts: channels from 0 to 255.
_RGB = "(SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 17 % 256 AS b FROM part)"


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE power(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"


_LUMINANCE = f"(0.2126e0 * ({_linear('r')}) + 0.7152e0 * ({_linear('g')}) + 0.0722e0 * ({_linear('b')}))"


def hsl(source: str) -> str:
    """SQL: source (with channels r, g, b from 0 to 255 and other columns) with hue h in degrees, saturation s and lightness l."""
    extremes = f"(SELECT *, greatest(r, g, b) / 255e0 AS mx, least(r, g, b) / 255e0 AS mn, r / 255e0 AS rf, g / 255e0 AS gf, b / 255e0 AS bf FROM {source} AS c0)"
    hue = "CASE WHEN mx = mn THEN 0e0 WHEN mx = rf THEN 60e0 * ((gf - bf) / (mx - mn)) + CASE WHEN gf < bf THEN 360e0 ELSE 0e0 END WHEN mx = gf THEN 60e0 * ((bf - rf) / (mx - mn)) + 120e0 ELSE 60e0 * ((rf - gf) / (mx - mn)) + 240e0 END"
    return f"(SELECT *, {hue} AS h, (mx + mn) / 2 AS l, CASE WHEN mx = mn THEN 0e0 WHEN (mx + mn) / 2 < 0.5e0 THEN (mx - mn) / (mx + mn) ELSE (mx - mn) / (2 - mx - mn) END AS s FROM {extremes} AS c1)"


def from_hsl(h: str, s: str, l: str) -> list[str]:  # noqa: E741
    """SQL: the channels, from 0 to 1, of a hue in degrees, a saturation and a lightness, clamped to 1."""

    def channel(turn: int) -> str:
        t = f"(({h}) + {turn} - floor((({h}) + {turn}) / 360e0) * 360e0)"
        q = f"(CASE WHEN ({l}) < 0.5e0 THEN ({l}) * (1 + ({s})) ELSE ({l}) + ({s}) - ({l}) * ({s}) END)"
        p_ = f"(2 * ({l}) - {q})"
        return f"least(1e0, greatest(0e0, CASE WHEN {t} < 60 THEN {p_} + ({q} - {p_}) * {t} / 60e0 WHEN {t} < 180 THEN {q} WHEN {t} < 240 THEN {p_} + ({q} - {p_}) * (240 - {t}) / 60e0 ELSE {p_} END))"

    return [channel(120), channel(0), channel(-120)]


def scaled(x: str, factor: str) -> str:
    """SQL: x moved towards 1, or towards 0 for a negative factor, by that share."""
    return f"greatest(0e0, {x} + greatest(0e0, CASE WHEN {factor} >= 0 THEN 1 - {x} ELSE {x} END) * ({factor}))"


#: Ends of the pieces that map hues of light to hues of paint, in degrees.
RGB_WHEEL = [0, 35, 60, 120, 180, 240, 300, 360]
RYB_WHEEL = [0, 60, 122, 165, 218, 275, 330, 360]


def wheel(h: str, of: list[int], to: list[int]) -> str:
    """SQL: a hue carried from the pieces of one wheel to those of another."""
    pieces = [f"({to[i]} + (({h}) - {of[i]}) * {to[i + 1] - to[i]} / {of[i + 1] - of[i]}e0)" for i in range(len(of) - 1)]
    return "CASE " + " ".join(f"WHEN ({h}) < {of[i + 1]} THEN {x}" for i, x in enumerate(pieces[:-1])) + f" ELSE {pieces[-1]} END"


def turned(h: str, by: float) -> str:
    return f"(({h}) + {by} - floor((({h}) + {by}) / 360e0) * 360e0)"


def turned_ryb(h: str, by: float) -> str:
    return wheel(turned(wheel(h, RGB_WHEEL, RYB_WHEEL), by), RYB_WHEEL, RGB_WHEEL)


def lab(source: str, tag: str = "") -> str:
    """SQL: source (with r, g, b and other columns, each with the tag) with CIE L, a and b under D65."""
    r, g, b = (_linear(c + tag) for c in "rgb")
    xyz = f"(SELECT *, (0.4124564e0 * {r} + 0.3575761e0 * {g} + 0.1804375e0 * {b}) / 0.95047e0 AS x{tag}, 0.2126729e0 * {r} + 0.7151522e0 * {g} + 0.0721750e0 * {b} AS y{tag}, (0.0193339e0 * {r} + 0.1191920e0 * {g} + 0.9503041e0 * {b}) / 1.08883e0 AS z{tag} FROM {source} AS l0)"
    f = lambda v: f"CASE WHEN {v} > 0.008856451679035631e0 THEN power({v}, 1e0 / 3) ELSE (903.2962962962963e0 * {v} + 16) / 116 END"
    return f"(SELECT *, 116 * ({f('y' + tag)}) - 16 AS ll{tag}, 500 * (({f('x' + tag)}) - ({f('y' + tag)})) AS la{tag}, 200 * (({f('y' + tag)}) - ({f('z' + tag)})) AS lb{tag} FROM {xyz} AS l1)"


def delta_e(source: str) -> str:
    """SQL: source (with ll, la, lb and ll2, la2, lb2) with de, the difference of 2000 by the published formula."""
    angle = lambda a, b: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0e0 ELSE degrees(atan2({b}, {a})) + CASE WHEN atan2({b}, {a}) < 0 THEN 360 ELSE 0 END END"
    steps = [
        "(sqrt(la * la + lb * lb) + sqrt(la2 * la2 + lb2 * lb2)) / 2 AS cm",
        "0.5e0 * (1 - sqrt(power(cm, 7e0) / (power(cm, 7e0) + 6103515625e0))) AS gg",
        "la * (1 + gg) AS a1, la2 * (1 + gg) AS a2",
        f"sqrt(a1 * a1 + lb * lb) AS c1, sqrt(a2 * a2 + lb2 * lb2) AS c2, {angle('a1', 'lb')} AS h1, {angle('a2', 'lb2')} AS h2",
        "CASE WHEN c1 * c2 = 0 THEN 0e0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (c1 + c2) / 2 AS cc, (ll + ll2) / 2 AS lm",
        "2 * sqrt(c1 * c2) * sin(radians(dh / 2)) AS dhh, 1 - 0.17e0 * cos(radians(hm - 30)) + 0.24e0 * cos(radians(2 * hm)) + 0.32e0 * cos(radians(3 * hm + 6)) - 0.2e0 * cos(radians(4 * hm - 63)) AS tt, 30 * exp(-power((hm - 275) / 25, 2e0)) AS th, 2 * sqrt(power(cc, 7e0) / (power(cc, 7e0) + 6103515625e0)) AS rc, 1 + 0.015e0 * power(lm - 50, 2e0) / sqrt(20 + power(lm - 50, 2e0)) AS sl, 1 + 0.045e0 * cc AS sc",
        "1 + 0.015e0 * cc * tt AS sh, -sin(radians(2 * th)) * rc AS rt",
        "sqrt(power((ll2 - ll) / sl, 2e0) + power((c2 - c1) / sc, 2e0) + power(dhh / sh, 2e0) + rt * ((c2 - c1) / sc) * (dhh / sh)) AS de",
    ]
    for i, step in enumerate(steps):
        source = f"(SELECT *, {step} FROM {source} AS d{i})"
    return source


def _shown(names: list[str], channels: list[str]) -> str:
    return ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {n}" for n, x in zip(names, channels, strict=True))


def _changed(h: str = "h", s: str = "s", l: str = "l") -> str:  # noqa: E741
    return f"SELECT p_partkey, {_shown(['r2', 'g2', 'b2'], from_hsl('h2', 's2', 'l2'))} FROM (SELECT p_partkey, {h} AS h2, {s} AS s2, {l} AS l2 FROM {hsl(_RGB)} AS c) AS d"


def _hues(*turns: str) -> str:
    return f"SELECT p_partkey, {', '.join(f'round(CAST({t} AS DOUBLE), 6) AS hue{i}' for i, t in enumerate(turns))} FROM {hsl(_RGB)} AS c"


#: The sixteen basic colour names.
NAMES = {"black": "000000", "silver": "c0c0c0", "gray": "808080", "white": "ffffff", "maroon": "800000", "red": "ff0000", "purple": "800080", "fuchsia": "ff00ff", "green": "008000", "lime": "00ff00", "olive": "808000", "yellow": "ffff00", "navy": "000080", "blue": "0000ff", "teal": "008080", "aqua": "00ffff"}
_NAMED = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in NAMES.items()) + ") AS named(name, hex)"

# The other colour of a pair.
_PAIR = "(SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 17 % 256 AS b, p_partkey * 53 % 256 AS r2, p_partkey * 29 % 256 AS g2, p_partkey * 71 % 256 AS b2 FROM part)"
_LUM2 = f"(0.2126e0 * ({_linear('r2')}) + 0.7152e0 * ({_linear('g2')}) + 0.0722e0 * ({_linear('b2')}))"

# Perceptual coordinates of light (r1, g1, b1: linear) and back: fixed values of the published space.
_OK = """(SELECT *, power(0.4122214708e0 * r1 + 0.5363325363e0 * g1 + 0.0514459929e0 * b1, 1e0 / 3) AS lc, power(0.2119034982e0 * r1 + 0.6806995451e0 * g1 + 0.1073969566e0 * b1, 1e0 / 3) AS mc, power(0.0883024619e0 * r1 + 0.2817188376e0 * g1 + 0.6299787005e0 * b1, 1e0 / 3) AS sc FROM %s AS k0)"""
_OK_AB = "(SELECT *, 1.9779984951e0 * lc - 2.4285922050e0 * mc + 0.4505937099e0 * sc AS oa, 0.0259040371e0 * lc + 0.7827717662e0 * mc - 0.8086757660e0 * sc AS ob FROM %s AS k1)"


def _from_ok(tag: str, lum: str) -> str:
    """SQL: the linear channels of a lightness with oa and ob."""
    cubes = f"power({lum} + 0.3963377774e0 * oa + 0.2158037573e0 * ob, 3e0) AS lk, power({lum} - 0.1055613458e0 * oa - 0.0638541728e0 * ob, 3e0) AS mk, power({lum} - 0.0894841775e0 * oa - 1.2914855480e0 * ob, 3e0) AS sk"
    out = "4.0767416621e0 * lk - 3.3077115913e0 * mk + 0.2309699292e0 * sk, -1.2684380046e0 * lk + 2.6097574011e0 * mk - 0.3413193965e0 * sk, -0.0041960863e0 * lk - 0.7034186147e0 * mk + 1.7076147010e0 * sk".split(", ")
    channels = ", ".join(f"{x} AS {c}{tag}" for x, c in zip(out, "rgb", strict=True))
    return cubes, channels


def contrast_repaired(source: str, ratio: float) -> str:
    """SQL: source (with r, g, b before a background of r2, g2, b2) with the linear channels ro, go, bo of a colour that stands out by ratio; null if it does already, or none does.

    Each candidate's own contrast decides.
    """
    lum = lambda a, b, c: f"(0.2126e0 * {a} + 0.7152e0 * {b} + 0.0722e0 * {c})"
    contrast = lambda x: f"CASE WHEN {x} > bg THEN ({x} + 0.05e0) / (bg + 0.05e0) ELSE (bg + 0.05e0) / ({x} + 0.05e0) END"
    q = f"(SELECT *, {_linear('r')} AS r1, {_linear('g')} AS g1, {_linear('b')} AS b1, {_LUM2} AS bg FROM {source} AS e0)"
    q = _OK_AB % (_OK % q)
    q = f"(SELECT *, {lum('r1', 'g1', 'b1')} AS fg, least(1e0, greatest(0.05e0, (bg + 0.05e0) / {ratio} - 0.05e0)) AS low, least(1e0, greatest(0.05e0, (bg + 0.05e0) * {ratio} - 0.05e0)) AS high FROM {q} AS e1)"
    for tag, level in (("d", "low"), ("u", "high")):
        cubes, channels = _from_ok(tag, level)
        q = f"(SELECT *, {channels.replace('lk', f'lk{tag}').replace('mk', f'mk{tag}').replace('sk', f'sk{tag}')} FROM (SELECT *, {cubes.replace(' lk', f' lk{tag}').replace(' mk', f' mk{tag}').replace(' sk', f' sk{tag}')} FROM {q} AS e{tag}) AS f{tag})"
    q = f"(SELECT *, {contrast('fg')} AS now, {contrast(lum('rd', 'gd', 'bd'))} AS cd, {contrast(lum('ru', 'gu', 'bu'))} AS cu FROM {q} AS e2)"
    choice = f"CASE WHEN now >= {ratio} THEN 'none' WHEN fg < bg AND cd >= {ratio} THEN 'd' WHEN cu >= {ratio} THEN 'u' WHEN cd >= {ratio} THEN 'd' ELSE 'none' END"
    return f"(SELECT *, {', '.join(f'CASE {choice} WHEN {chr(39)}d{chr(39)} THEN {c}d WHEN {chr(39)}u{chr(39)} THEN {c}u END AS {c}o' for c in 'rgb')} FROM {q} AS e3)"


QUERIES = {
    # Hue, saturation and lightness, and back.
    "hsla": Query(f"SELECT p_partkey, {_shown(['hue', 'saturation', 'light'], ['h', 's', 'l'])}, 1.0e0 AS alpha FROM {hsl(_RGB)} AS c"),
    "from_hsla": Query(_changed()),
    # Saturation and lightness by a share, up and down, and by a fixed amount.
    "saturate": Query(_changed(s=f"CASE WHEN p_partkey % 2 = 0 THEN {scaled('s', '0.3e0')} ELSE {scaled('s', '-0.3e0')} END")),
    "saturate_fixed": Query(_changed(s="greatest(0e0, s + 0.1e0)")),
    "lighten": Query(_changed(l=f"CASE WHEN p_partkey % 2 = 0 THEN {scaled('l', '0.2e0')} ELSE {scaled('l', '-0.2e0')} END")),
    "lighten_fixed": Query(_changed(l="greatest(0e0, l - 0.1e0)")),
    # Hues turned, on both wheels.
    "hue_turned": Query(_changed(h=turned("h", 30))),
    "hue_turned_ryb": Query(_hues(turned_ryb("h", 45), turned_ryb("h", 180))),
    "hue_triad": Query(_hues(turned("h", 120), turned("h", -120))),
    "hue_square": Query(_hues(turned("h", 90), turned("h", 270), turned("h", 180))),
    # M05, M15
    "lab": Query(f"SELECT p_partkey, {_shown(['lightness', 'a', 'b2'], ['ll', 'la', 'lb'])} FROM {lab(_RGB)} AS c"),
    "delta_e": Query(f"SELECT p_partkey, round(CAST(de AS DOUBLE), 5) AS difference FROM {delta_e(lab(lab(_PAIR), '2'))} AS c"),
    # Of any two colours; M19: repaired to 4.5.
    "contrast_ratio": Query(f"SELECT p_partkey, round(CAST(greatest({_LUMINANCE} + 0.05e0, {_LUM2} + 0.05e0) / least({_LUMINANCE} + 0.05e0, {_LUM2} + 0.05e0) AS DOUBLE), 6) AS ratio FROM {_PAIR} AS c"),
    "contrast_repaired": Query(f"SELECT p_partkey, {_shown(['ro', 'go', 'bo'], ['ro', 'go', 'bo'])} FROM {contrast_repaired(_PAIR, 4.5)} AS c"),
    # Seven colours from one end to the other.
    "gradient": Query("SELECT p_partkey, i, round(CAST((r + (r2 - r) * i / 6e0) / 255e0 AS DOUBLE), 6) AS red, round(CAST((g + (g2 - g) * i / 6e0) / 255e0 AS DOUBLE), 6) AS green, round(CAST((b + (b2 - b) * i / 6e0) / 255e0 AS DOUBLE), 6) AS blue FROM (SELECT *, SERIES(CAST(0 AS BIGINT), CAST(6 AS BIGINT))) AS i FROM %s AS p) AS c" % _PAIR),
    # A colour's text, by hexadecimal digits or by name.
    "parse_colour": Query(
        f"SELECT p_partkey, CAST(conv(substring(hex, 1, 2), 16, 10) AS INT) AS red, CAST(conv(substring(hex, 3, 2), 16, 10) AS INT) AS green, CAST(conv(substring(hex, 5, 2), 16, 10) AS INT) AS blue FROM (SELECT p_partkey, CASE WHEN spec LIKE '#%' THEN substring(spec, 2) ELSE hex END AS hex FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'navy' WHEN 1 THEN '#a0b1c2' WHEN 2 THEN 'Lime' ELSE 'unknown' END AS spec FROM part) AS p LEFT JOIN {_NAMED} ON named.name = lower(spec)) AS x",
        f"SELECT p_partkey, CAST('0x' || substring(hex, 1, 2) AS INT) AS red, CAST('0x' || substring(hex, 3, 2) AS INT) AS green, CAST('0x' || substring(hex, 5, 2) AS INT) AS blue FROM (SELECT p_partkey, CASE WHEN spec LIKE '#%' THEN substring(spec, 2) ELSE hex END AS hex FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'navy' WHEN 1 THEN '#a0b1c2' WHEN 2 THEN 'Lime' ELSE 'unknown' END AS spec FROM part) AS p LEFT JOIN {_NAMED} ON named.name = lower(spec)) AS x",
    ),
    "named_colour": Query(f"SELECT name, hex FROM {_NAMED}"),
    # Sixteen bits a channel, and eight of linear light.
    "x11_colour": Query(f"SELECT p_partkey, format_string('rgb:%04x/%04x/%04x', r * 257, g * 257, b * 257) AS colour FROM {_RGB} AS c", f"SELECT p_partkey, printf('rgb:%04x/%04x/%04x', r * 257, g * 257, b * 257) AS colour FROM {_RGB} AS c"),
    "eight_bits": Query(f"SELECT p_partkey, CAST(floor({_linear('r')} * 255) AS INT) AS red FROM {_RGB} AS c"),
    # M03, M17, M16
    "linear_light": Query(f"SELECT p_partkey, round(CAST({_linear('r')} AS DOUBLE), 9) AS r_linear FROM {_RGB} AS c"),
    "relative_luminance": Query(f"SELECT p_partkey, round(CAST({_LUMINANCE} AS DOUBLE), 9) AS luminance FROM {_RGB} AS c"),
    "contrast_with_black": Query(f"SELECT p_partkey, round(CAST(({_LUMINANCE} + 0.05e0) / 0.05e0 AS DOUBLE), 6) AS ratio FROM {_RGB} AS c"),
    # M22, M23
    "hex_colour": Query(f"SELECT p_partkey, format_string('#%02x%02x%02x', r, g, b) AS colour FROM {_RGB} AS c", f"SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS colour FROM {_RGB} AS c"),
    "rgba_colour": Query(f"SELECT p_partkey, concat('rgba(', CAST(r AS STRING), ' ', CAST(g AS STRING), ' ', CAST(b AS STRING), ' 100%)') AS colour FROM {_RGB} AS c"),
    # Lightness alone.
    "lightness": Query(f"SELECT p_partkey, round(CAST((greatest(r, g, b) + least(r, g, b)) / 510.0e0 AS DOUBLE), 9) AS lightness FROM {_RGB} AS c"),
    # Whole hues on the wheel.
    "hue_rotation": Query("SELECT p_partkey, (p_size * 7 + 120) % 360 AS rotated, (p_size * 7 + 180) % 360 AS complement FROM part"),
    # M27
    "scaled": Query("SELECT p_partkey, round(CAST(greatest(0, p_size / 100.0e0 + greatest(0, 1 - p_size / 100.0e0) * 0.25e0) AS DOUBLE), 9) AS scaled FROM part"),
    # M18, M25
    "interpolated": Query(f"SELECT p_partkey, round(CAST(r * 0.75e0 + g * 0.25e0 AS DOUBLE), 6) AS mixed, round(CAST(b * 0.5e0 AS DOUBLE), 6) AS halved FROM {_RGB} AS c"),
}
