"""Options of a sampler from INI texts, with defaults and checks. A text of options is small and is read on the driver."""

from __future__ import annotations

import configparser
from collections.abc import Callable
from dataclasses import dataclass

SECTION = "TFBS-Sampler"
PRIORS = ("pitman-yor process", "uniform process", "poppe process")
BACKGROUNDS = ("independence-dirichlet", "independence-mixture-dirichlet", "default-background", "entropy-background", "dirichlet-mixture")

#: The format's keys with their defaults, which also tell the values' types.
DEFAULTS: dict[str, object] = {
    "alignment-file": "", "phylogenetic-file": "", "save": "", "socket-file": "", "background-cache": "",
    "alpha": 0.05, "discount": 0.0, "lambda": 0.01, "initial-temperature": 10.0,
    "block-samples": False, "optimize": False,
    "block-samples-period": 1, "optimize-period": 1, "metropolis-proposals": 4, "background-context": 2, "population-size": 1, "threads": 1, "verbose": 0,
    "process-prior": "pitman-yor process", "background-model": "independence-dirichlet",
    "background-alpha": [[1.0, 1.0, 1.0, 1.0, 5.0]], "background-beta": [10.0, 10.0], "background-gamma": [5.0, 0.2], "background-weights": [],
    "samples": (1000, 100),
}


@dataclass
class Baseline:
    """A prior of motifs: the range of their lengths, pseudocounts as five rows of columns, and a weight."""

    name: str
    lengths: tuple[int, int]
    counts: list[list[float]]
    weight: float


def truth(text: str) -> bool:
    value = {"yes": True, "true": True, "on": True, "1": True, "no": False, "false": False, "off": False, "0": False}.get(text.strip().lower())
    if value is None:
        raise ValueError(f"neither yes nor no: {text}")
    return value


def vector(text: str) -> list[float]:
    """Numbers parted by white space or line ends; ``-`` is an empty row."""
    return [float(x) for x in text.split() if x != "-"]


def matrix(text: str) -> list[list[float]]:
    return [vector(line) for line in text.splitlines() if line.strip()]


def matrix_text(rows: list[list[float]]) -> str:
    """Lines that ``matrix`` reads back."""
    return "".join("\n\t" + (" ".join(map(repr, map(float, r))) or "-") for r in rows)


def _reader(default: object) -> Callable[[str], object]:
    if isinstance(default, bool):
        return truth
    if isinstance(default, tuple):
        return lambda t: tuple(int(x) for x in t.split(":"))
    if isinstance(default, list):
        return matrix if default and isinstance(default[0], list) else vector
    return type(default)


def read_options(text: str) -> tuple[dict[str, object], list[Baseline]]:
    """Options by key and the named baseline priors, whose weights sum to 1. Raises ValueError for what isn't allowed."""
    parser = configparser.ConfigParser(interpolation=None, delimiters=("=",))
    parser.optionxform = str
    parser.read_string(text)
    if SECTION not in parser:
        raise ValueError(f"no section [{SECTION}]")
    own = parser[SECTION]
    options = dict(DEFAULTS)
    for key, default in DEFAULTS.items():
        if key in own:
            options[key] = _reader(default)(own[key])
    if options["process-prior"] not in ("", *PRIORS):
        raise ValueError(f"unknown process prior: {options['process-prior']}")
    if options["background-model"] not in BACKGROUNDS:
        raise ValueError(f"unknown background model: {options['background-model']}")
    if len(options["samples"]) != 2:
        raise ValueError("samples are two numbers, as in 1000:100")
    names = own.get("baseline-priors", "").split()
    weights = vector(own.get("baseline-weights", "")) or [1.0] * len(names)
    if len(weights) != len(names) or any(w < 0 for w in weights) or names and not sum(weights):
        raise ValueError("every baseline prior needs a weight, not all of them 0")
    found = []
    for name, weight in zip(names, weights):
        if name not in own or f"{name}_length" not in own:
            raise ValueError(f"baseline prior without counts or length: {name}")
        ends = [int(x) for x in own[f"{name}_length"].split("-")]
        counts = matrix(own[name])
        if len(counts) != 5 or len({len(r) for r in counts}) != 1 or not 0 < ends[0] <= ends[-1] or len(ends) > 2:
            raise ValueError(f"baseline prior that is not five rows with a range of lengths: {name}")
        found.append(Baseline(name, (ends[0], ends[-1]), counts, weight / sum(weights)))
    return options, found
