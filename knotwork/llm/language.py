"""Which language a text is in, by its script and its common words."""

from __future__ import annotations

import re

# Common words of each language.
COMMON = {
    "en": "the of and to in a is that it was for on are as with at be this by not or from but had have were which an their has when all they its been one can there so we what who did no if more then how why after before into me my than only some most any each both under over does also although because while where may could should would will about between through during without above below very such these those them our your his her he she you i do".split(),
    "de": "der die das und in zu den mit von ist im für auf nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn kann keine obwohl weil warum welche wir ich wurden blieb gleich musste".split(),
    "fr": "le la les de des du un une et à est en que qui dans pour pas sur au plus par ce il ne se sont avec son ont mais comme ou nous cette été aux ses leur être fait elle deux même ces sans aussi bien parce quel quelle pourquoi n'est après puis cela dû restée l'effet était sa".split(),
    "es": "el la los las de del un una y en que a se por con no para su al lo como más o pero sus le ha me sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde mi porque qué qual sólo han yo hay vez puede todos así nos ni parte tiene uno donde bien mismo ese ahora cada tuvo después aunque cómo indica".split(),
    "it": "il lo la i gli le di del della dei delle un uno una e è in che non per con su da al alla nel nella come più ma ha hanno sono era stato stata anche questo questa si ed dopo prima perché benché quale dove quando senza tra fra molto".split(),
    "nl": "de het een van en in is dat op te voor met zijn niet aan door als bij ook maar om uit naar dan nog wel er werd wordt was worden heeft had deze dit die wat omdat hoewel na over tot zoals geen meer kan zou".split(),
    "pt": "o a os as de do da dos das um uma e em no na que não para com por se mais como mas foi são está ao à pelo pela seu sua já também muito após porque embora quando onde até sem entre".split(),
    "pl": "i w na z do nie się to jest że o jak po co za od przez dla był była było są ale tak już tylko czy który która które oraz przy pod bez ponieważ chociaż gdy między".split(),
    "sv": "och i att det som en på är av för med den till ett inte har om var men han sig från vid så kan när ut också efter eller under mellan utan eftersom blev där mycket".split(),
    "ru": "и в не на с что по как из к у за от для но до или о его это бы был была были при так уже только также если мы они она он же ли все после без том чем хотя потому который которая почему между под над через во".split(),
}
SETS = {k: frozenset(v) for k, v in COMMON.items()}
MAIN = {k: SETS[k] for k in ("en", "de", "fr", "es", "ru")}  # with Chinese, the languages that texts are ranked in
HAN = frozenset("的一是在了不和有中为与这因对使用以后而也或者从到被由于及其可将之前后经过但尽管")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CJK = re.compile(r"[㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


_LANGUAGES = list(SETS)
_MARKS: dict[str, tuple[int, ...]] = {}
for _n, _k in enumerate(_LANGUAGES):
    for _w in SETS[_k]:
        _MARKS[_w] = (*_MARKS.get(_w, ()), _n)


def common_counts(words: list[str]) -> dict[str, int]:
    counts = [0] * len(_LANGUAGES)
    for marks in filter(None, map(_MARKS.get, words)):
        for n in marks:
            counts[n] += 1
    return dict(zip(_LANGUAGES, counts))


def detect(text: str, least: int = 2) -> str | None:
    """The language, or None where too little speaks for one (names, numbers, single words)."""
    han = len(_CJK.findall(text))
    if han >= 4 and han * 8 >= len(text) // 2:
        return "zh"
    cyrillic = len(_CYRILLIC.findall(text))
    if cyrillic >= 8 and cyrillic * 6 >= len(text):
        return "ru"
    words = _WORD.findall(text.lower())
    counts = common_counts(words)
    best = max(counts, key=counts.get)
    rest = max(v for k, v in counts.items() if k != best)
    return best if counts[best] >= least and counts[best] > rest and counts[best] * 12 >= len(words) else None
