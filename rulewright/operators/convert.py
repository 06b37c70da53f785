"""Rules and templates of other taggers in this library's syntax."""

from __future__ import annotations

import re

#: Lexical kinds and the atom that says the same; {0} is the affix or word, {n} its length (fixed values of the format).
LEXICAL = {
    "hassuf": "word_0::~~{n}=~~{0}",
    "haspref": "word_0::{n}~~={0}~~",
    "addsuf": "word_0::++{n}=++{0}",
    "addpref": "word_0::{n}++={0}++",
    "deletesuf": "word_0::--{n}=--{0}",
    "deletepref": "word_0::{n}--={0}--",
    "goodright": "word^^-1={0}",
    "goodleft": "word^^1={0}",
    "char": "word_0::1<>={0}<>",
}
#: Contextual kinds and their atoms; {0} and {1} are the kind's arguments in order (fixed values of the format).
CONTEXTUAL = {
    "CURWD": "word_0={0}",
    "LBIGRAM": "word_0={1} word_-1={0}",
    "NEXT1OR2OR3TAG": "pos:[1,3]={0}",
    "NEXT1OR2TAG": "pos:[1,2]={0}",
    "NEXT1OR2WD": "word:[1,2]={0}",
    "NEXT2TAG": "pos_2={0}",
    "NEXT2WD": "word_2={0}",
    "NEXTBIGRAM": "pos_1={0} pos_2={1}",
    "NEXTTAG": "pos_1={0}",
    "NEXTWD": "word_1={0}",
    "PREV1OR2OR3TAG": "pos:[-3,-1]={0}",
    "PREV1OR2TAG": "pos:[-2,-1]={0}",
    "PREV1OR2WD": "word:[-2,-1]={0}",
    "PREV2TAG": "pos_-2={0}",
    "PREV2WD": "word_-2={0}",
    "PREVBIGRAM": "pos_-1={1} pos_-2={0}",
    "PREVTAG": "pos_-1={0}",
    "PREVWD": "word_-1={0}",
    "RBIGRAM": "word_0={0} word_1={1}",
    "SURROUNDTAG": "pos_-1={0} pos_1={1}",
    "WDAND2AFT": "word_0={0} word_2={1}",
    "WDAND2BFR": "word_0={1} word_-2={0}",
    "WDAND2TAGAFT": "word_0={0} pos_2={1}",
    "WDAND2TAGBFR": "word_0={1} pos_-2={0}",
    "WDNEXTTAG": "word_0={0} pos_1={1}",
    "WDPREVTAG": "word_0={1} pos_-1={0}",
}


def tagger_rule(line: str) -> str | None:
    """A rule ``.. => pos=T`` for a lexical or contextual rule of a transformation tagger; None if it is neither."""
    words = line.replace("STAART", "ZZZ").split()
    if len(words) >= 4 and words[2] in CONTEXTUAL:
        return f"pos_0={words[0]} {CONTEXTUAL[words[2]].format(*words[3:])} => pos={words[1]}"
    for at, before in ((1, 0), (2, 1)):  # a kind led by f also tests the present class
        kind = words[at][1:] if len(words) > at and before and words[at].startswith("f") else words[at] if len(words) > at and not before else ""
        if kind in LEXICAL:
            rest = words[at + 1 :]
            sized = "{n}" in LEXICAL[kind]
            if len(rest) < 1 + sized:
                return None
            atom = LEXICAL[kind].format(words[at - 1], n=rest[0] if sized else 1)
            return (f"pos_0={words[0]} " if before else "") + f"{atom} => pos={rest[sized]}"
    return None


def chunk_template(code: str, columns: dict[str, str], target: str = "chunk") -> str:
    """A template from a code such as ``P0P_1`` or ``T_1_2``: a letter of ``columns``, then offsets (_n: n back); several
    offsets are a range from the first to the last."""
    atoms = []
    for letter, offsets in re.findall(r"([A-Z])((?:_?\d)+)", code):
        at = [-int(x[1:]) if x[0] == "_" else int(x) for x in re.findall(r"_?\d", offsets)]
        atoms.append(f"{columns[letter]}_{at[0]}" if len(at) == 1 else f"{columns[letter]}:[{at[0]},{at[-1]}]")
    return " ".join(atoms) + f" => {target}"
