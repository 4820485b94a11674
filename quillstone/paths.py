"""Where a workspace keeps its files, below one data folder."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Paths:
    """The data folder's entries; ``make`` creates the folders that are missing."""

    data: str

    @property
    def library(self) -> str:
        return os.path.join(self.data, "library")

    @property
    def state_file(self) -> str:
        return os.path.join(self.data, "browser_state", "state.json")

    @property
    def saved_info(self) -> str:
        return os.path.join(self.data, "auth_info.json")

    def make(self) -> Paths:
        for folder in (self.data, os.path.dirname(self.state_file)):
            os.makedirs(folder, exist_ok=True)
        return self
