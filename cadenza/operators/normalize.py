"""Space normalisation: punctuation, quotes, and hyphens of listed compounds, as one fold of ordered rules.

A rule is a pattern and its replacement; phrases are compiled into one alternation per rule, so a text is
passed over once per rule and not once per phrase.  Stress marks may stand behind any vowel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACUTE = "́"
# Marks that lose the space before them.
NO_SPACE_BEFORE = ",.?!…;:"
# Words that take "-то".
INDEFINITE = ("когда кто кого чего где как куда откуда почему отчего зачем потому что чем кем кому ком чём чему чей чья чье чьё чьи "
              "чьих чьим чьей чью какой какая какое какие какого какую какие каких каким").split()
# First parts of compound adjectives.
COLOUR_PARTS = ("ярко алкогольно бледно винно военно дорожно желто жёлто фиолетово коричнево интимно красновато культурно молочно научно "
                "опто плоско розовато светло северо серо темно тёмно условно учебно черно чёрно чисто яблочно ядерно сине алма аль блек "
                "вип йошкар нежно янтарно бело красно").split()
# Compounds of two words.
COMPOUNDS = [
    "все - таки", "всё - таки", "рахат - лукум", "давным - давно", "очень - очень", "чуть - чуть", "жил - был", "туда - сюда", "вот - вот",
    "кое - кем", "кое - чем", "кое - кому", "кое - чему", "кое - кто", "кое - где", "кое - куда", "кое - когда", "кое - как", "кое - что",
    "сикось - накось", "крест - накрест", "ай - кью", "из - за", "из - под", "общем - то", "в - восьмых", "в - девятых", "в - десятых",
    "в - пятых", "в - седьмых", "в - третьих", "в - четвертых", "в - шестых", "ва - банк", "джиу - джитсу", "едва - едва", "едва - лишь",
    "едва - только", "зачем - либо", "зачем - то", "из - подо", "как - либо", "как - никак", "как - то", "какая - либо", "какая - то",
    "каким - либо", "каким - то", "какими - либо", "какими - то", "каких - либо", "каких - то", "какой - либо", "какой - то", "каком - либо",
    "каком - то", "какому - либо", "какому - то", "какою - либо", "какою - то", "какую - либо", "какую - то", "ей - богу", "когда - либо",
    "когда - то", "кой - где", "кой - как", "кой - кем", "кой - когда", "кой - кого", "кой - кому", "кой - кто", "кой - куда", "ком - либо",
    "ком - то", "кому - либо", "кому - то", "куда - либо", "куда - то", "наконец - то", "ноу - хау", "то - то", "опять - таки", "откуда - либо",
    "откуда - то", "подобру - поздорову", "полным - полно", "потому - то", "почему - либо", "почему - то", "раным - ранехонько",
    "раным - ранешенько", "сан - франциско", "сперва - наперво", "так - сяк", "так - то", "там - сям", "там - то", "темным - темно",
    "тогда - то", "туда - то", "тут - то", "тяп - ляп", "хухры - мухры", "чей - либо", "чей - то", "чем - либо", "чем - то", "чему - либо",
    "чему - то", "чуть - только", "чьей - либо", "чьей - то", "чьем - либо", "чьем - то", "чьему - либо", "чьему - то", "чьею - либо",
    "чьею - то", "чьи - либо", "чьи - то", "чьим - либо", "чьим - то", "чьими - либо", "чьими - то", "чьих - либо", "чьих - то", "чью - либо",
    "чью - то", "чья - либо", "чья - то", "шиворот - навыворот", "нон - стоп", "кто - либо", "всего - то", "много - много", "во - первых",
    "во - вторых", "еле - еле", "жила - была", "день - деньской", "ё - моё", "тихо - тихо", "совсем - совсем", "взад - вперёд",
]
# Compounds by their stems; ``*`` stands for more letters.
STEM_COMPOUNDS = [
    "баб* - яг*", "бизнес* - блок*", "бизнес* - дам*", "буэнос* - айрес*", "вагон* - ресторан*", "гогол* - могол*", "город* - геро*",
    "грин* - карт*", "далай* - лам*", "дресс* - код*", "жар* - птиц*", "жить* - быть*", "жук* - скарабе*", "каминг* - аут*",
    "кают* - компание*", "киндер* - сюрприз*", "кок* - кол*", "кокер* - спаниел*", "лас* - вегас*", "лос* - анджелес*", "ляпис* - лазур*",
    "мюзик* - холл*", "нарьян* - мар*", "норд* - вест*", "норд* - ост*", "нью - йорк*", "пепси - кол*", "пин - код*", "пинг* - понг*",
    "пит - стоп*", "плащ - палатк*", "плей - офф*", "поп - див*", "прайс - лист*", "прима - балерин*", "рахат - лукум*", "рок - групп*",
    "рок - звезд*", "рок - звёзд*", "санкт - петербург*", "сант* - барбар*", "сант* - клаус*", "секонд - хенд*", "секс - бомб*", "сим - карт*",
    "стоп - кран*", "стоп - линие*", "стоп - сигнал*", "сыр - бор*", "тайм* - аут*", "там - там*", "тель - авив*", "той - терьер*",
    "торрент - трекер*", "тянь - шан*", "фокус* - покус*", "ханты - мансийск*", "хит - парад*", "хот - дог*", "хула - хуп*", "хэппи - энд*",
]
RU_VOWELS = "аеёиоуыэюя"


def stressed(phrase: str, vowels: str = RU_VOWELS) -> str:
    """The phrase as a pattern in which any vowel may carry a stress mark."""
    return "".join(c + f"{ACUTE}?" if c in vowels else c for c in phrase)


def rules(indefinite: list[str] = INDEFINITE, parts: list[str] = COLOUR_PARTS, compounds: list[str] = COMPOUNDS,
          stems: list[str] = STEM_COMPOUNDS, suffixes: tuple = ("ка", "нибудь"),
          leading: str = "по", indefinite_ending: str = "то", vowels: str = RU_VOWELS) -> list[tuple[str, str]]:
    """(pattern, replacement) in order."""
    out = [("‌", " "), (f" ([{NO_SPACE_BEFORE}])", "$1"), ("« ", "«"), (" »", "»"), ("\" ([^\n]+) \"", "\"$1\"")]
    if indefinite:
        out.append((f"(?iu)({'|'.join(stressed(w, vowels) for w in sorted(set(indefinite), key=len, reverse=True))}) - {indefinite_ending}", f"$1-{indefinite_ending}"))
    for s in suffixes:
        out.append((f"(?iu) - {s}(?![\\p{{L}}\\p{{N}}_])", f"-{s}"))
    if leading:
        out.append((f"(?iu)(?<![\\p{{L}}\\p{{N}}_]){leading} - (?=[\\p{{L}}\\p{{N}}_])", f"{leading}-"))
    if parts:
        out.append((f"(?iu)(?<![\\p{{L}}\\p{{N}}_])({'|'.join(stressed(p, vowels) for p in parts)}) - (?=[\\p{{L}}\\p{{N}}_])", "$1-"))
    if compounds:
        pairs = "|".join(f"{stressed(a, vowels)} - (?={stressed(b, vowels)})" for a, b in (c.split(" - ") for c in compounds))
        out.append((f"(?iu)(?:{pairs})", None))
    if stems:
        more = "[\\p{L}\\p{N}_]+"
        pairs = "|".join(f"{a.replace('*', more)} - (?={b.replace('*', more)})" for a, b in (c.split(" - ") for c in stems))
        out.append((f"(?iu)(?:{pairs})", None))
    return out


def normalize_spaces(text: Column, rule_list: list[tuple[str, str | None]] | None = None) -> Column:
    """The text after all rules, in order.  A rule without replacement joins what it matches: the `` - `` at the
    match's end becomes a hyphen."""
    def one(s: Column, rule: tuple[str, str | None]) -> Column:
        pattern, to = rule
        if to is not None:
            return F.regexp_replace(s, pattern, to)
        return F.replace(F.regexp_replace(s, f"({pattern})", "$1\u0001"), F.lit(" - \u0001"), F.lit("-"))
    return reduce(one, rules() if rule_list is None else rule_list, text)
