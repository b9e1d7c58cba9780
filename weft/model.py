"""Edge kinds and morphisms."""

from __future__ import annotations

from enum import Enum

UND, SRC, TGT, ANY = "UND", "SRC", "TGT", "ANY"
#: A slot seen from the other end.
FLIP = {UND: UND, SRC: TGT, TGT: SRC, ANY: ANY}


class Kind(Enum):
    """Which edges a pair of nodes may have. SRC is an edge from the pair's smaller id to its larger one, TGT the reverse."""

    UNDIR = (UND,)
    DIR = (SRC, TGT)
    ANYDIR = (SRC, TGT, UND)

    @property
    def slots(self) -> tuple[str, ...]:
        return self.value

    def check(self, slot: str) -> None:
        """TypeError for an edge operator that the kind doesn't have."""
        if slot != ANY and slot not in self.value:
            raise TypeError(f"{slot} edges don't exist in a graph of kind {self.name}")


class Morphism(Enum):
    """(injective, surjective, induced)."""

    ISO = (True, True, True)
    SUBISO = (True, False, True)
    EPIMONO = (True, True, False)
    MONO = (True, False, False)
    EPI = (False, True, False)
    HOMO = (False, False, False)

    @property
    def injective(self) -> bool:
        return self.value[0]

    @property
    def surjective(self) -> bool:
        return self.value[1]

    @property
    def induced(self) -> bool:
        return self.value[2]

    def meet(self, other: Morphism) -> Morphism:
        """The weakest morphism that is as strict as both; all six are closed under it."""
        return Morphism(tuple(a or b for a, b in zip(self.value, other.value, strict=True)))
