"""Words that the translation rules look up."""

from __future__ import annotations

# The words of ordinals.
POLISH_ORDINALS = {
    1: "pierwszy", 2: "drugi", 3: "trzeci", 4: "czwarty", 5: "piąty", 6: "szósty", 7: "siódmy", 8: "ósmy", 9: "dziewiąty", 10: "dziesiąty",
    11: "jedenasty", 12: "dwunasty", 13: "trzynasty", 14: "czternasty", 15: "piętnasty", 16: "szesnasty", 17: "siedemnasty", 18: "osiemnasty", 19: "dziewiętnasty",
    20: "dwudziesty", 30: "trzydziesty", 40: "czterdziesty", 50: "pięćdziesiąty", 60: "sześćdziesiąty", 70: "siedemdziesiąty", 80: "osiemdziesiąty", 90: "dziewięćdziesiąty",
}
# The words of numbers.
POLISH_NUMBERS = {
    0: "zero", 1: "jeden", 2: "dwa", 3: "trzy", 4: "cztery", 5: "pięć", 6: "sześć", 7: "siedem", 8: "osiem", 9: "dziewięć", 10: "dziesięć",
    11: "jedenaście", 12: "dwanaście", 13: "trzynaście", 14: "czternaście", 15: "piętnaście", 16: "szesnaście", 17: "siedemnaście", 18: "osiemnaście", 19: "dziewiętnaście",
    20: "dwadzieścia", 30: "trzydzieści", 40: "czterdzieści", 50: "pięćdziesiąt", 60: "sześćdziesiąt", 70: "siedemdziesiąt", 80: "osiemdziesiąt", 90: "dziewięćdziesiąt",
    100: "sto", 200: "dwieście", 300: "trzysta", 400: "czterysta", 500: "pięćset", 600: "sześćset", 700: "siedemset", 800: "osiemset", 900: "dziewięćset",
}
# The words of ordinals in answers.
ENGLISH_ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth",
    "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
)
# The words of numbers in answers.
ENGLISH_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 1000000, "b": 1000000000, "bn": 1000000000, "billion": 1000000000, "trillion": 1000000000000,
}
# Times of the day and their translations.
TIME_WORDS = {
    "evening": "wieczór", "night": "noc", "midnight": "północ", "morning": "ranek", "day": "dzień", "sundown": "zachód słońca", "late afternoons": "popołudnia", "12 minutes past 2": "2:12",
}
# Words of dates and their translations.
DATE_WORDS = {
    "monday": "poniedziałek", "tuesday": "wtorek", "wednesday": "środa", "wednesdays": "środy", "thursday": "czwartek", "friday": "piątek", "saturday": "sobota", "sunday": "niedziela", "sundays": "niedziele",
    "january": "styczeń", "february": "luty", "march": "marzec", "april": "kwiecień", "may": "maj", "june": "czerwiec", "july": "lipiec", "august": "sierpień", "september": "wrzesień",
    "october": "październik", "oct.": "październik", "november": "listopad", "nov.": "listopad", "december": "grudzień",
    "century": "wiek", "winter": "zima", "spring": "wiosna", "summer": "lato", "autumn": "jesień", "fall": "jesień", "weekend": "weekend", "christmas": "Boże Narodzenie",
    "to": "do", "and": "i", "in": "w", "-": "-", "through": "-",
}
# Months as they stand in dates.
MONTHS_OF_DATES = {
    "styczeń": "stycznia", "luty": "lutego", "marzec": "marca", "kwiecień": "kwietnia", "maj": "maja", "czerwiec": "czerwca", "lipiec": "lipca", "sierpień": "sierpnia",
    "wrzesień": "września", "październik": "października", "listopad": "listopada", "grudzień": "grudnia",
}
# Currencies and units, in the order they are tried.
CURRENCIES = {
    "us$": "dolar", "£": "funt", "€": "euro", "¥": "juan", "₹": "rupia", "euros": "euro", "us dollars": "dolar", "dollars": "dolar", "pounds": "funt", "pesos": "pesos", "yuan": "juan",
    "francs": "franków", "swiss francs": "franków", "cents": "cent", "reais": "reais", "nt$": "dolar", "s$": "dolar",
    "#": "", "tonnes": "ton", "litres": "litr", "barrels": "baryłka", "hectares": "hektar", "gallons": "galon",
}
# Scales and their translations.
SCALES = {"thousand": "tysiąc", "million": "milion", "m": "milion", "billion": "miliard", "b": "miliard", "bn": "miliard", "trillion": "trylion"}
# Phrases of dates, in the order they are replaced.
DATE_PHRASES = (
    ("the ", ""), ("mid-", ""), ("mid ", ""), ("late ", ""), ("early ", ""), ("fall of ", "fall "), ("autumn of ", "autumn "), ("summer of ", "summer "), ("spring of ", "spring "), ("first half of ", ""),
    ("second half of ", ""), ("first decade of ", ""), ("last decade of ", ""), ("latter half of ", ""), ("end of ", ""), ("century bc", "century"), ("century ce", "century"),
)
# A model's labels and the types they stand for.
ENTITY_LABELS = {"geogName": "LOCATION", "placeName": "LOCATION", "persName": "PERSON", "orgName": "ORGANIZATION", "date": "DATE", "time": "TIME"}
MOST_ROMAN = 21


def roman(n: int) -> str:
    """By the rule, so that no table is needed."""
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out
