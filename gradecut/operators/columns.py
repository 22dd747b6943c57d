"""Names of the columns an offers table uses, so every operator runs on any such table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradecut.functions import keys


@dataclass(frozen=True)
class OfferCols:
    group: tuple[str, ...] = ("county",)
    identity: tuple[str, ...] = keys.IDENTITY_COLS
    key: tuple[str, ...] = ("school_code", "spec_id")
    year: str = "year"
    mark_h: str = "last_media_h"
    seats: str = "seats"
    occupied: str = "occupied_seats"
    vocational: str = "vocational"
    name: str = "school_name"
    compose: bool = False

    def usable_mark(self) -> Column:
        return keys.usable_mark(
            F.col(self.mark_h), F.col(self.occupied), F.col(self.seats), F.col(self.vocational)
        )

    def identity_parts(self) -> list[Column]:
        return [
            keys.identity_part(F.col(c), self.compose).alias(f"id_{c}") for c in self.identity
        ]

    @property
    def key_and_name(self) -> list[str]:
        return list(dict.fromkeys([*self.key, self.name]))

    @property
    def identity_names(self) -> list[str]:
        return [f"id_{c}" for c in self.identity]
