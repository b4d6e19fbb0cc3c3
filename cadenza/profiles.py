"""Language profiles and fixed rule values.

A profile is the only way language enters the operators.  ``ru`` carries the
values of the verse toolkit the engine re-creates; ``latin`` is our profile for
the Latin-script fixture tables (en/de/fr/es).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    name: str
    vowels: str          # lower-case vowel letters
    closing: str         # consonants that may close a syllable ('' = none)
    soft_sign: str       # letters that extend a closing consonant

    @property
    def vowel_class(self) -> str:
        return "[" + self.vowels + "]"

    @property
    def non_vowel_class(self) -> str:
        return "[^" + self.vowels + "]"


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's rules for right results)
# ---------------------------------------------------------------------------
# Vowels used by the syllable splitter: Cyrillic vowels plus Latin aeiou.
RU_VOWELS = "аеёиоуыэюяaeiou"
# Consonants that can close a syllable.
RU_CLOSING = "рлймн"
# Soft sign extends a closed syllable.
RU_SOFT = "ь"

# Our Latin-script profile (fixtures): vowel letters including accented ones.
LATIN_VOWELS = "aeiouyàâäáéèêëîïíôöóûùüúœæ"

RU = Profile("ru", RU_VOWELS, RU_CLOSING, RU_SOFT)
LATIN = Profile("latin", LATIN_VOWELS, "", "")

PROFILES = {"ru": RU, "latin": LATIN}


def profile(name: str | Profile) -> Profile:
    return name if isinstance(name, Profile) else PROFILES[name]


# ---------------------------------------------------------------------------
# Metre templates, error borders and classifier coefficients,
# in the classifier's tie-break order.
# (name, template, error border, coef, sum_coef)
# ---------------------------------------------------------------------------
METRES = [
    ("iambos", "(us)*(uS)(U)?(U)?", 7, 0.3, 0.0),
    ("choreios", "(su)*(S)(U)?(U)?", 7, 0.3, 0.0),
    ("daktylos", "(suu)*(S)(U)?(U)?", 7, 0.4, 0.0),
    ("amphibrachys", "(usu)*(uS)(U)?(U)?", 7, 0.4, 0.0),
    ("anapaistos", "(uus)*(uuS)(U)?(U)?", 7, 0.4, 0.0),
    ("dolnik3", "(u)?(u)?((su)(u)?)*(S)(U)?(U)?", 3, 0.5, 0.035),
    ("dolnik2", "(u)?(u)?((s)(u)?)*(S)(U)?(U)?", 3, 0.5, 0.035),
    ("taktovik3", "(u)?(u)?((su)(u)?(u)?)*(S)(U)?(U)?", 2, 6.0, 0.10),
    ("taktovik2", "(u)?(u)?((s)(u)?(u)?)*(S)(U)?(U)?", 2, 6.0, 0.10),
]
# Lines longer than this many syllables are not matched against metres.
BORDER_SYLLABLES = 20

# Repeating feet for the cyclic metre fit (0 = unstressed).
FEET = [
    ("trochee", "10"),
    ("iamb", "01"),
    ("dactyl", "100"),
    ("amphibrach", "010"),
    ("anapaest", "001"),
]
