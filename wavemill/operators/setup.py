"""The setup of a stream of block packets: codebook numbers, floors, residues, mappings and modes.

One walk over the layout writes or reads it, whichever its bits are for. A setup is a plain nested dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wavemill.operators.books import Bits, Book, width_of

#: Fixed by the format: how many heights a floor has by its multiplier 1..4.
RANGES = {1: 256, 2: 128, 3: 86, 4: 64}


def _each(io: Bits, n: int, values: list | None, bits: int, less: int = 0) -> list[int]:
    return [io.field(bits, values[i] if values else None, less) for i in range(n)]


def _floor(io: Bits, f: dict) -> dict:
    classes = _each(io, io.field(5, f and len(f["classes"])), f.get("classes"), 4)
    kinds = []
    for i in range(max(classes, default=-1) + 1):
        own = f["kinds"][i] if f else {}
        kind = {"dim": io.field(3, own.get("dim"), less=1), "bits": io.field(2, own.get("bits"))}
        kind["master"] = io.field(8, own.get("master")) if kind["bits"] else None
        kind["books"] = _each(io, 1 << kind["bits"], own.get("books"), 8, less=-1)
        kinds.append(kind)
    multiplier = io.field(2, f.get("multiplier"), less=1)
    bits = io.field(4, f.get("bits"))
    inner = _each(io, sum(kinds[c]["dim"] for c in classes), f.get("inner"), bits)
    return {"classes": classes, "kinds": kinds, "multiplier": multiplier, "bits": bits, "inner": inner}


def _residue(io: Bits, r: dict) -> dict:
    out = {"type": io.field(2, r.get("type")), "begin": io.field(24, r.get("begin")), "end": io.field(24, r.get("end"))}
    out["size"] = io.field(24, r.get("size"), less=1)
    n = io.field(6, r and len(r["books"]), less=1)
    out["classbook"] = io.field(8, r.get("classbook"))
    stages = []
    for i in range(n):
        have = sum(1 << s for s, b in enumerate(r["books"][i]) if b >= 0) if r else None
        low = io.field(3, have if have is None else have & 7)
        more = io.field(1, have if have is None else int(have > 7))
        stages.append(low | (io.field(5, have if have is None else have >> 3) << 3 if more else 0))
    out["books"] = [
        [io.field(8, r["books"][i][s] if r else None) if stages[i] >> s & 1 else -1 for s in range(8)] for i in range(n)
    ]
    return out


def _mapping(io: Bits, m: dict, channels: int) -> dict:
    several = io.field(1, m and int(len(m["floors"]) > 1))
    submaps = io.field(4, m and len(m["floors"]), less=1) if several else 1
    steps = io.field(8, m and len(m["coupling"]), less=1) if io.field(1, m and int(bool(m["coupling"]))) else 0
    bits = width_of(channels - 1)
    coupling = [tuple(_each(io, 2, m and m["coupling"][i], bits)) for i in range(steps)]
    if io.field(2, 0):
        raise ValueError("mapping is malformed")
    mux = _each(io, channels, m.get("mux"), 4) if submaps > 1 else [0] * channels
    floors, residues = [], []
    for i in range(submaps):
        io.field(8, 0)
        floors.append(io.field(8, m["floors"][i] if m else None))
        residues.append(io.field(8, m["residues"][i] if m else None))
    return {"coupling": coupling, "mux": mux, "floors": floors, "residues": residues}


def _walk(io: Bits, s: dict, channels: int) -> dict:
    def part(bits: int, name: str, one) -> list:
        n = io.field(bits, s and len(s[name]), less=1)
        return [one(s[name][i] if s else {}) for i in range(n)]

    return {
        "books": part(8, "books", lambda b: io.field(10, None if b == {} else b)),
        "floors": part(6, "floors", lambda f: _floor(io, f)),
        "residues": part(6, "residues", lambda r: _residue(io, r)),
        "mappings": part(6, "mappings", lambda m: _mapping(io, m, channels)),
        "modes": part(6, "modes", lambda m: {"long": io.field(1, m.get("long")), "mapping": io.field(8, m.get("mapping"))}),
    }


def pack(setup: dict, channels: int) -> bytes:
    io = Bits()
    _walk(io, setup, channels)
    return io.tobytes()


def parse(data: bytes, channels: int) -> dict:
    """The setup in ``data``; ``clean`` tells whether less than a byte of zeros is left over."""
    io = Bits(data)
    out = _walk(io, {}, channels)
    pad = io.left
    out["clean"] = pad < 8 and not io.get(pad)
    return out


def check(setup: dict, books: int) -> None:
    """Refuse a setup whose parts name others that it does not have."""
    named = [b for f in setup["floors"] for k in f["kinds"] for b in (k["master"], *k["books"]) if b is not None and b >= 0]
    named += [b for r in setup["residues"] for b in (r["classbook"], *(x for row in r["books"] for x in row if x >= 0))]
    parts = [(named, books, "codebook")]
    parts += [(m[p], len(setup[p]), p) for m in setup["mappings"] for p in ("floors", "residues")]
    parts.append(([m["mapping"] for m in setup["modes"]], len(setup["mappings"]), "mapping"))
    for numbers, there, what in parts:
        if any(not 0 <= x < there for x in numbers):
            raise ValueError(f"setup names a {what} that it does not have")


def submap_of(mapping: dict, channel: int) -> int:
    """The submap of a channel; the first for channels that the mapping does not name."""
    return mapping["mux"][channel] if channel < len(mapping["mux"]) else 0


def propagate(used: list[bool], coupling: list[tuple[int, int]]) -> list[bool]:
    """A coupled pair is coded together as soon as either channel has a floor."""
    out = list(used)
    for m, a in coupling:
        if not (0 <= m < len(out) and 0 <= a < len(out)):
            raise ValueError("coupling names a channel that is not there")
        out[m] = out[a] = out[m] or out[a]
    return out


def post_places(floor: dict) -> list[int]:
    """Where a floor's posts stand: both ends first, then the inner ones as stored."""
    return [0, 1 << floor["bits"], *floor["inner"]]


def fields(setup: dict) -> list[tuple[str, int, str, int]]:
    """A setup as rows: section, index, field, value."""
    rows = [("books", i, "id", b) for i, b in enumerate(setup["books"])]
    for i, f in enumerate(setup["floors"]):
        rows += [("floors", i, "multiplier", f["multiplier"]), ("floors", i, "posts", 2 + len(f["inner"]))]
        rows += [("floors", i, f"x{k}", x) for k, x in enumerate(f["inner"])]
    for i, r in enumerate(setup["residues"]):
        rows += [("residues", i, k, r[k]) for k in ("type", "begin", "end", "size", "classbook")]
        rows += [("residues", i, f"book{c}.{s}", b) for c, row in enumerate(r["books"]) for s, b in enumerate(row) if b >= 0]
    for i, m in enumerate(setup["mappings"]):
        rows += [("mappings", i, f"pair{k}.{n}", v) for k, pair in enumerate(m["coupling"]) for n, v in zip("ma", pair)]
    return rows + [("modes", i, k, m[k]) for i, m in enumerate(setup["modes"]) for k in ("long", "mapping")]


def parsed_fields(setups: DataFrame, channels: int, body: str = "setup") -> DataFrame:
    """``fields`` of each setup packet, one row a field, with the packet's ``id``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, *row) for i, raw in zip(batch["id"].to_pylist(), batch[body].to_pylist()) for row in fields(parse(raw, channels))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
            names = ["id", "section", "nr", "field", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return setups.select("id", body).mapInArrow(run, "id bigint, section string, nr int, field string, value bigint")


# A profile of our own ---------------------------------------------------------------------------


def _even(n: int, dim: int, count: int, step: float = 1.0) -> Book:
    """A book of ``count`` ** ``dim`` entries around zero, with lengths that differ by one at most."""
    from wavemill.operators.entropy import balanced_lengths

    return Book(dim, tuple(balanced_lengths(n)), tuple(range(count)), -(count // 2) * step, step)


def profile(channels: int, short: int = 256, long: int = 2048) -> tuple[dict, list[Book]]:
    """A setup and its codebooks that code any integer residue up to 3,429 exactly.

    Small classes take one stage of up to ±1, ±2 or ±4; larger ones a coarse stage of steps of 19 * 19, one of 19 and one of 1.
    """
    from wavemill.operators.entropy import balanced_lengths

    plain = lambda n: Book(1, tuple(balanced_lengths(n)))
    books = [
        Book(2, tuple(balanced_lengths(64))),  # 0: two classes of 8
        Book(2, tuple(balanced_lengths(100))),  # 1: two classes of 10
        _even(81, 4, 3),  # 2: ±1
        _even(25, 2, 5),  # 3: ±2
        _even(81, 2, 9),  # 4: ±4
        _even(19, 1, 19),  # 5: ±9
        _even(19, 1, 19, 19.0),  # 6: multiples of 19
        _even(19, 1, 19, 361.0),  # 7: multiples of 361
        plain(256),  # 8: floor heights
        plain(32),  # 9: small floor heights
        plain(16),  # 10: which of two books four heights take
    ]
    coarse, fine = [7, 6, 5], [6, 5]
    row = lambda *stages: [*stages, *[-1] * (8 - len(stages))]
    mono = [row(), row(2), row(2), row(3), row(3), row(4), row(*fine), row(*coarse)]
    pair = [row(), row(2), row(*coarse), row(3), row(*coarse), row(4), row(*fine), row(*fine), row(*fine), row(*coarse)]
    kind = {"dim": 4, "bits": 1, "master": 10, "books": [9, 8]}
    floors, residues = [], []
    for size in (short, long):
        bits = width_of(size // 2 - 1)
        inner = sorted({int(round((size / 2) ** (k / 17))) for k in range(1, 17)} - {0, 1 << bits})
        inner = (inner + [x for x in range(1, 1 << bits) if x not in inner])[: max(4, len(inner) // 4 * 4)]
        floors.append({"classes": [0] * (len(inner) // 4), "kinds": [kind], "multiplier": 1, "bits": bits, "inner": inner})
        joint = channels == 2
        end = size // 2 * (2 if joint else 1)
        residues.append(
            {"type": 2 if joint else 1, "begin": 0, "end": end, "size": 16, "classbook": 1 if joint else 0, "books": pair if joint else mono}
        )
    coupling = [(0, 1)] if channels == 2 else []
    mappings = [{"coupling": coupling, "mux": [0] * channels, "floors": [i], "residues": [i]} for i in (0, 1)]
    modes = [{"long": 0, "mapping": 0}, {"long": 1, "mapping": 1}]
    return {"books": list(range(len(books))), "floors": floors, "residues": residues, "mappings": mappings, "modes": modes}, books
