"""gradecut: threshold forecasting on panel data, as DataFrame-to-DataFrame operators."""

from gradecut.session import build_session, checked_broadcast, cut_lineage

__all__ = ["build_session", "checked_broadcast", "cut_lineage"]
