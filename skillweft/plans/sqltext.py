"""SQL spellings of the text functions, built from the same word lists."""

from skillweft import dictionaries as d

WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_in(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def pick(text: str, pairs, test: str = "contains") -> str:
    if test == "equal":
        arms = " ".join(f"WHEN {text} = {lit(k)} THEN {lit(v)}" for k, v in pairs)
    else:
        arms = " ".join(f"WHEN contains({text}, {lit(k)}) THEN {lit(v)}" for k, v in pairs)
    return f"(CASE {arms} END)"


def synonym(x: str) -> str:
    """English synonym of a lower-case word: equal key, else the first key contained either way."""
    loose = " ".join(f"WHEN contains({x}, {lit(k)}) OR contains({lit(k)}, {x}) THEN {lit(v)}" for k, v in d.SYNONYMS)
    return f"coalesce({pick(x, d.SYNONYMS, 'equal')}, CASE {loose} END)"


def normalize_skill(x: str) -> str:
    text = strip(f"lower(coalesce({x}, ''))")
    phrases = sorted(d.INDONESIAN_SKILLS, key=lambda p: len(p[0]), reverse=True)
    text = f"coalesce({pick(text, phrases)}, {text})"
    text = f"replace({text}, '/', ' ')"
    text = rf"regexp_replace({text}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\s\-+#./]', '', 'g')"
    text = rf"regexp_replace({text}, '\s+', ' ', 'g')"
    text = rf"regexp_replace({text}, '^[\s\-.(]+|[\s\-.)]+$', '', 'g')"
    return f"trim(translate({text}, ',-', '  '))"


def title_case(x: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\p{{L}}+|\P{{L}}+)'), "
            "lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '')")


def clean_title(x: str) -> str:
    text = rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
    for p in d.TITLE_SUFFIX_PATTERNS:
        text = f"regexp_replace({text}, {lit('(?i)' + p)}, '', 'g')"
    text = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    drop = ", ".join(map(lit, d.SENIORITY_WORDS))
    keep = ", ".join(map(lit, d.TITLE_ACRONYMS))
    return (f"array_to_string(list_transform(list_filter(string_split({text}, ' '), "
            f"lambda w: w <> '' AND translate(w, ',()', '') NOT IN ({drop})), "
            f"lambda w: CASE WHEN upper(w) IN ({keep}) THEN upper(w) "
            "ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')")
