"""Cardinal numbers in words: English, German, French, Spanish; any other language gets English."""

from __future__ import annotations

import re

# Fixed value: what is taken for a number.
_NUMBER = re.compile(r"[-+]?\d[\d.,]*")

# Number words.
_UNITS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve "
    "veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve",
}
_TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety",
    "de": "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig",
    "fr": "vingt trente quarante cinquante soixante soixante quatre-vingt quatre-vingt",
    "es": "veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa",
}
_HUNDREDS_ES = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos"
# Names of 10^6, 10^9, 10^12, ...; in Spanish of 10^6, 10^12, 10^18, ...
_SCALES = {
    "en": "million billion trillion quadrillion quintillion sextillion",
    "de": "Million Milliarde Billion Billiarde Trillion Trilliarde",
    "fr": "million milliard billion billiard trillion trilliard",
    "es": "millón billón trillón",
}
_POINT = {"en": "point", "de": "Komma", "fr": "virgule", "es": "punto"}
_MINUS = {"en": "minus", "de": "minus", "fr": "moins", "es": "menos"}


def _below_hundred(n: int, lang: str) -> str:
    units, tens = _UNITS[lang].split(), _TENS[lang].split()
    if n < len(units):
        return units[n]
    ten, unit = tens[n // 10 - 2], n % 10
    if lang == "de":
        return ten if not unit else ("ein" if unit == 1 else units[unit]) + "und" + ten
    if lang == "es":
        return ten if not unit else f"{ten} y {units[unit]}"
    if lang == "fr":
        if n // 10 in (7, 9):
            unit += 10
        if n == 80:
            return "quatre-vingts"
        if not unit:
            return ten
        return f"{ten} et {units[unit]}" if unit in (1, 11) and n < 80 else f"{ten}-{units[unit]}"
    return ten if not unit else f"{ten}-{units[unit]}"


def _below_thousand(n: int, lang: str) -> str:
    if n < 100:
        return _below_hundred(n, lang)
    units, hundred, rest = _UNITS[lang].split(), n // 100, n % 100
    if lang == "en":
        return f"{units[hundred]} hundred" + (f" and {_below_hundred(rest, lang)}" if rest else "")
    if lang == "de":
        return ("ein" if hundred == 1 else units[hundred]) + "hundert" + (_below_hundred(rest, lang) if rest else "")
    if lang == "fr":
        head = "cent" if hundred == 1 else f"{units[hundred]} cent" + ("" if rest else "s")
        return head + (f" {_below_hundred(rest, lang)}" if rest else "")
    return "cien" if n == 100 else _HUNDREDS_ES.split()[hundred - 1] + (f" {_below_hundred(rest, lang)}" if rest else "")


def _es_before_noun(words: str) -> str:
    return re.sub(r"veintiuno$", "veintiún", words) if words.endswith("veintiuno") else re.sub(r"uno$", "un", words)


def _below_million(n: int, lang: str) -> str:
    thousands, rest = n // 1000, n % 1000
    if not thousands:
        return _below_thousand(rest, lang)
    head = _below_thousand(thousands, lang)
    if lang == "de":
        return ("ein" if thousands == 1 else head) + "tausend" + (_below_thousand(rest, lang) if rest else "")
    if lang == "fr":
        head = "mille" if thousands == 1 else f"{re.sub('(cent|vingt)s$', r'\1', head)} mille"
    elif lang == "es":
        head = "mil" if thousands == 1 else f"{_es_before_noun(head)} mil"
    else:
        head = f"{head} thousand"
    joint = (" and " if rest < 100 else ", ") if lang == "en" else " "
    return head + (joint + _below_thousand(rest, lang) if rest else "")


def _scaled(n: int, scale: str, lang: str) -> str:
    """n times a scale word, with what the language does to both."""
    if lang == "de":
        return f"eine {scale}" if n == 1 else f"{_below_thousand(n, lang)} {scale}" + ("n" if scale.endswith("e") else "en")
    if lang == "fr":
        return f"{_below_thousand(n, lang)} {scale}" + ("s" if n > 1 else "")
    if lang == "es":
        return f"un {scale}" if n == 1 else f"{_es_before_noun(_below_million(n, lang))} {scale.replace('ón', 'ones')}"
    return f"{_below_thousand(n, lang)} {scale}"


def cardinal(n: int, lang: str) -> str:
    """A number below 10^24 in words; beyond that, digit by digit."""
    if n >= 10**24:
        return " ".join(_UNITS[lang].split()[int(d)] for d in str(n))
    step, parts, high = (10**6 if lang == "es" else 10**3), [], n // 10**6
    for scale in _SCALES[lang].split():
        high, group = divmod(high, step)
        if group:
            parts.insert(0, _scaled(group, scale, lang))
    rest = n % 10**6
    if rest or not parts:
        parts.append(_below_million(rest, lang))
    if lang != "en":
        return " ".join(parts)
    # what is below a hundred is joined by "and"
    return ", ".join(parts) if rest >= 100 or not rest else " and ".join(x for x in (", ".join(parts[:-1]), parts[-1]) if x)


def _value(raw: str) -> tuple[bool, str, str]:
    """(negative, whole digits, decimal digits)"""
    negative, bare = raw[0] == "-", raw.lstrip("+-").rstrip(".,")
    if found := re.search(r"[.,](\d{1,2})$", bare):
        return negative, re.sub(r"[.,]", "", bare[: found.start()]), found[1].rstrip("0")
    return negative, re.sub(r"[.,]", "", bare), ""


def spell(text: str, lang: str | None) -> str:
    """The text with its numbers in words."""
    lang = lang if lang in _UNITS else "en"

    def words(match: re.Match) -> str:
        negative, whole, decimals = _value(match[0])
        out = cardinal(int(whole or 0), lang)
        if decimals:
            out += f" {_POINT[lang]} " + " ".join(_UNITS[lang].split()[int(d)] for d in decimals)
        return f" {_MINUS[lang] + ' ' if negative else ''}{out} "

    return _NUMBER.sub(words, text)
