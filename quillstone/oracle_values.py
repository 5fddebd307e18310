"""Fixed values of the SQL side, stated a second time after their published definitions, so that SQL checks the library's own."""

# Field letters in order and their weights; sizes.
FIELDS = tuple("tibcrl")
WEIGHTS = dict(zip(FIELDS, (10, 5, 1, 5, 2, 2), strict=True))
CHUNK_DOCS = 10_000
SHARD_TOKENS = 10_000

# The usual English stop words without those that hold an apostrophe, by kind.
STOP_WORDS = " ".join((
    "i me my myself we our ours ourselves you your yours yourself yourselves",
    "he him his himself she her hers herself it its itself they them their theirs themselves",
    "what which who whom this that these those",
    "am is are was were be been being have has had having do does did doing",
    "a an the and but if or because as until while of at by for with about against between into through during",
    "before after above below to from up down in out on off over under again further then once",
    "here there when where why how all any both each few more most other some such",
    "no nor not only own same so than too very can will just don should now",
    "s t d ll m o re ve y ma",
    "ain aren couldn didn doesn hadn hasn haven isn mightn mustn needn shan shouldn wasn weren won wouldn",
)).split()

# Characters that become spaces (the first tokenizer has the em dash, the second the tilde), and blanks.
_MARKS = r"""\x27\x60"|.*\[\]{}();:,="""
SPECIALS_V1 = "[" + r"\x{2014}" + _MARKS + r"\-+_!?/><&\\#$@%\n]"
SPECIALS_V2 = "[" + _MARKS + r"~\-+_!?/><&\\#$@%\n]"
_BLANKS = r" \t\n\r\x0B\x0C\x1C-\x1F"
BLANKS_ASCII = f"[{_BLANKS}]+"
BLANKS_UNICODE = f"[{_BLANKS}" + r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# Fixed values of the Porter2 stemmer: double consonants, endings before li, words and beginnings that are exceptions.
DOUBLES = tuple(c + c for c in "bdfgmnprt")
LI_ENDINGS = frozenset("cdeghkmnrt")
REGION_PREFIXES = ("gener", "commun", "arsen")
EXCEPTIONS = dict(pair.split(":") for pair in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split())
EXCEPTIONS |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
INVARIANTS = frozenset("inning outing canning herring earring proceed exceed succeed".split())


def _endings(by_result: dict[str, str]) -> dict[str, str]:
    return {ending: result for result, endings in by_result.items() for ending in endings.split()}


# Fixed values of the Porter2 stemmer: the endings of steps 2, 3 and 4 by what takes their place.
STEP2 = _endings({
    "tion": "tional", "ence": "enci", "ance": "anci", "able": "abli", "ent": "entli", "ize": "izer ization", "ate": "ational ation ator", "al": "alism aliti alli",
    "ful": "fulness fulli", "ous": "ousli ousness", "ive": "iveness iviti", "ble": "biliti bli", "less": "lessli",
})
STEP3 = _endings({"tion": "tional", "ate": "ational", "al": "alize", "ic": "icate iciti ical", "": "ful ness"})
STEP4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split())
