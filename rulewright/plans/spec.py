"""What a task declares: columns, templates, rules, parameters. All of it is small and lives on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

#: Value of every column beyond either end of a sequence, and targets that match without a change (fixed values).
PAD, FAKE = "ZZZ", "FAKE_CLASS"


@dataclass(frozen=True)
class TaskSchema:
    """Columns of a task: features, then states, each with a truth. Samples also have ``seq`` and ``pos``."""

    features: tuple[str, ...]
    states: tuple[str, ...]
    truths: tuple[str, ...]
    truth_separator: str | None = None

    def __post_init__(self):
        if len(self.states) != len(self.truths):
            raise ValueError("each state needs one truth")
        for name in self.columns:
            if re.search(r"[=_:\-\s]", name):
                raise ValueError(f"column name {name!r} may not hold = _ : - or blanks")

    @property
    def columns(self) -> tuple[str, ...]:
        return self.features + self.states + self.truths

    @classmethod
    def parse(cls, line: str, truth_separator: str | None = None) -> TaskSchema:
        """``f1 .. fn s1 .. sm => t1 .. tm``."""
        left, arrow, right = line.partition("=>")
        names, truths = left.split(), right.split()
        if not arrow or not truths or len(names) < len(truths):
            raise ValueError(f"not a schema line: {line!r}")
        at = len(names) - len(truths)
        return cls(tuple(names[:at]), tuple(names[at:]), tuple(truths), truth_separator)


@dataclass(frozen=True)
class Atom:
    """One test of a template. kind: identity, range, set, prefix, suffix, add_prefix, add_suffix, drop_prefix, drop_suffix,
    contains, follows (the value stands after the column's in a bigram list) or precedes."""

    kind: str
    columns: tuple[str, ...]
    offset: int = 0
    last: int = 0
    size: int = 0
    text: str = ""

    @property
    def column(self) -> str:
        return self.columns[0]

    @property
    def needs_words(self) -> bool:
        return self.kind in ("add_prefix", "add_suffix", "drop_prefix", "drop_suffix", "follows", "precedes")

    def reads(self) -> set[tuple[str, int]]:
        """(column, offset) of all that it looks at."""
        span = range(self.offset, (self.last if self.kind == "range" else self.offset) + 1)
        return {(c, k) for c in self.columns for k in span}

    def shown(self, value: str) -> str:
        """A value as rules write it: affixes with their marks."""
        before, after = {"prefix": ("", "~~"), "suffix": ("~~", ""), "add_prefix": ("", "++"), "add_suffix": ("++", ""), "drop_prefix": ("", "--"), "drop_suffix": ("--", ""), "contains": ("", "<>")}.get(self.kind, ("", ""))
        return before + value + after

    def bare(self, value: str) -> str:
        if self.kind in ("prefix", "add_prefix", "drop_prefix", "contains"):
            return value[:-2]
        return value[2:] if self.kind in ("suffix", "add_suffix", "drop_suffix") else value


@dataclass(frozen=True)
class OwnKind:
    """A kind of atom from outside. Both functions take the column's value (at the atom's offset; the padding beyond the ends)
    as a Spark column: ``test`` also the rule's value, and gives whether the atom holds; ``instances`` gives all values that
    make it hold (array<string>), for learning."""

    test: Callable[[Column, Column], Column]
    instances: Callable[[Column], Column]


OWN_KINDS: dict[str, OwnKind] = {}


def register_atom(name: str, test: Callable[[Column, Column], Column], instances: Callable[[Column], Column]) -> None:
    """From now on ``f::name`` and ``f_k::name`` are atoms over features, in templates and rules, for all ways of applying rules."""
    if not re.fullmatch(r"[A-Za-z]\w*", name):
        raise ValueError(f"not a name for an atom: {name!r}")
    OWN_KINDS[name] = OwnKind(test, instances)


_NAME = r"([^=_:\-\s{}^]+)"
_AFFIX = {"~~": ("prefix", "suffix"), "++": ("add_prefix", "add_suffix"), "--": ("drop_prefix", "drop_suffix")}


def parse_atom(text: str, columns: tuple[str, ...] | None = None) -> Atom:
    """An atom from its syntax: f f_k f:[a,b] {f,g}_k f::n~~ f::~~n f::n++ f::++n f::n-- f::--n f::n<> f^^1 f^^-1,
    and f::name for a name of register_atom()."""
    found = None
    if m := re.fullmatch(r"\{([^}]*)\}(?:_(-?\d+))?", text):
        found = Atom("set", tuple(c.strip() for c in m[1].split(",")), int(m[2] or 0), text=text)
    elif m := re.fullmatch(_NAME + r"(?:_(-?\d+))?:\[(-?\d+),(-?\d+)\]", text):
        found = Atom("range", (m[1],), int(m[3]), int(m[4]), text=text)
    elif m := re.fullmatch(_NAME + r"(?:_(-?\d+))?\^\^(-?1)", text):
        found = Atom("follows" if m[3] == "1" else "precedes", (m[1],), int(m[2] or 0), text=text)
    elif m := re.fullmatch(_NAME + r"(?:_(-?\d+))?::(?:(\d+)(~~|\+\+|--|<>)|(~~|\+\+|--)(\d+))", text):
        mark, front = m[4] or m[5], m[4] is not None
        kind = "contains" if mark == "<>" else _AFFIX[mark][0 if front else 1]
        found = Atom(kind, (m[1],), int(m[2] or 0), size=int(m[3] or m[6]), text=text)
    elif (m := re.fullmatch(_NAME + r"(?:_(-?\d+))?::([A-Za-z]\w*)", text)) and m[3] in OWN_KINDS:
        found = Atom(m[3], (m[1],), int(m[2] or 0), text=text)
    elif m := re.fullmatch(_NAME + r"(?:_(-?\d+))?", text):
        found = Atom("identity", (m[1],), int(m[2] or 0), text=text)
    if not found:
        raise ValueError(f"not an atom: {text!r}")
    if found.kind == "range" and found.last < found.offset:
        raise ValueError(f"empty range: {text!r}")
    for c in found.columns if columns is not None else ():
        if c not in columns:
            raise ValueError(f"unknown column {c!r} in {text!r}")
    return found


@dataclass(frozen=True)
class Template:
    """A conjunction of atoms that rewrites target states."""

    atoms: tuple[Atom, ...]
    targets: tuple[str, ...]

    @property
    def text(self) -> str:
        return " ".join(a.text for a in self.atoms)

    def depends_on(self, changed: set[tuple[str, int]]) -> bool:
        return any(a.reads() & changed for a in self.atoms)


@dataclass(frozen=True)
class Templates:
    schema: TaskSchema
    items: tuple[Template, ...]
    aliases: dict[str, str] = field(default_factory=dict, hash=False, compare=False)

    @classmethod
    def parse(cls, text: str, schema: TaskSchema) -> Templates:
        """Lines ``atom .. => state ..``; ``name = definition`` for ``$name``; # begins a comment."""
        aliases: dict[str, str] = {}
        items: list[Template] = []
        known = schema.features + schema.states
        for line in (x.split("#")[0].strip() for x in text.splitlines()):
            if not line:
                continue
            left, arrow, right = line.partition("=>")
            if not arrow:
                name, equals, definition = line.partition("=")
                if not equals:
                    raise ValueError(f"neither a template nor an alias: {line!r}")
                aliases[name.strip()] = definition.strip()
                continue
            atoms = []
            for a in left.split():
                if a.startswith("$"):
                    atoms.append(Atom(**{**parse_atom(aliases[a[1:]], known).__dict__, "text": a}))
                else:
                    atoms.append(parse_atom(a, known))
            if bad := [t for t in right.split() if t not in schema.states]:
                raise ValueError(f"not states: {bad}")
            items.append(Template(tuple(atoms), tuple(right.split())))
        return cls(schema, tuple(items), aliases)

    @property
    def reach(self) -> int:
        """Rows that templates look at on either side."""
        return max([0, *(abs(k) for t in self.items for a in t.atoms for _, k in a.reads())])


@dataclass(frozen=True)
class Rule:
    """atoms with a value each => targets with a value each."""

    atoms: tuple[Atom, ...]
    values: tuple[str, ...]
    targets: tuple[str, ...]
    results: tuple[str, ...]
    good: int = 0
    bad: int = 0
    score: int = 0

    @property
    def fake(self) -> bool:
        return FAKE in self.results

    def renamed(self, names: dict[str, str]) -> Rule:
        """The same rule over columns called otherwise: ``pos``, say, is a place here and a part of speech elsewhere."""
        to = lambda c: names.get(c, c)
        atoms = tuple(Atom(**{**a.__dict__, "columns": tuple(map(to, a.columns))}) for a in self.atoms)
        return replace(self, atoms=atoms, targets=tuple(map(to, self.targets)))

    def text(self) -> str:
        left = " ".join(f"{a.text}={a.shown(v)}" for a, v in zip(self.atoms, self.values))
        return f"GOOD:{self.good} BAD:{self.bad} SCORE:{self.score} RULE: {left} => " + " ".join(f"{t}={v}" for t, v in zip(self.targets, self.results))

    @classmethod
    def parse(cls, line: str, aliases: dict[str, str] | None = None) -> Rule:
        head, _, body = line.rpartition("RULE:")
        numbers = {k: int(v) for k, v in re.findall(r"(GOOD|BAD|SCORE):(-?\d+)", head)}
        left, arrow, right = body.partition("=>")
        if not arrow:
            raise ValueError(f"not a rule: {line!r}")
        atoms, values = [], []
        for x in left.split():
            name, equals, value = x.partition("=")  # values may hold = themselves
            if not equals:
                raise ValueError(f"an atom without a value in {line!r}")
            atom = parse_atom((aliases or {}).get(name[1:], name) if name.startswith("$") else name)
            atoms.append(Atom(**{**atom.__dict__, "text": name}))
            values.append(atom.bare(value))
        pairs = [x.partition("=") for x in right.split()]
        return cls(tuple(atoms), tuple(values), tuple(p[0] for p in pairs), tuple(p[2] for p in pairs), numbers.get("GOOD", 0), numbers.get("BAD", 0), numbers.get("SCORE", 0))


def parse_rules(text: str, aliases: dict[str, str] | None = None) -> list[Rule]:
    return [Rule.parse(x, aliases) for x in text.splitlines() if x.strip() and not x.startswith("#")]


def parse_params(text: str) -> dict[str, str]:
    """``KEY = value;`` lines; ${KEY} stands for an earlier value, # begins a comment."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        if m := re.fullmatch(r"\s*(\w+)\s*=\s*(.*?)\s*;\s*", line.split("#")[0]):
            found[m[1]] = re.sub(r"\$\{(\w+)\}", lambda v: found.get(v[1], v[0]), m[2])
    return found
