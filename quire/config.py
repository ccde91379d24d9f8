"""Settings of layout reconstruction; coordinates are shares of the page's width and height."""

from __future__ import annotations

from dataclasses import dataclass

from quire.functions import patterns as P


@dataclass(frozen=True)
class Config:
    # fixed values: the defaults
    drop_stamp: bool = True
    stamp_conf: float = 0.88
    drop_header: bool = True
    drop_footer: bool = True
    header: str = P.HEADER
    footer: str = P.FOOTER
    header_y: float = 0.125
    footer_y: float = 0.85
    line_tol: float = 0.45
    gutter: float = 0.035
    full_line: float = 0.78
    x_tol: float = 0.025
    bullet_ind: float = 0.030
    bullet_ind_max: float = 0.10
    ind_step: float = 0.035
    ind_max: int = 15
    min_tbl_rows: int = 2
    tables: bool = True
    grid_tables: bool = True
    page_marker: bool = True
    figures: bool = True
    font_size: float = 10.5
    zh_font: str = "宋体"
    en_font: str = "Times New Roman"


#: Fixed values of single operators.
BREAK_SIZES, MIN_CHARS = 1.2, 20
RULE_HIGH, RULE_WIDE, RULE_SLIM = 10.0, 14.0, 0.25
COL_TOL, HOST_SLACK, CROSS_SLACK, COL_SLACK, ROW_GAP = 0.022, 0.01, 0.02, 0.02, 0.05
LEAD_WINDOW, LEAD, LEAD_FACTOR = 0.08, 0.02, 1.75
FILL = 0.85
SAME_GRID, SAME_TABLE = 0.02, 0.05
IND_MIN_HITS = 3
FORMATS = ("docx", "xlsx", "md", "pdf")
