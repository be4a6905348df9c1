"""How the types of a graph are drawn."""

from __future__ import annotations

# Type, name, colours of the font, the background and the border, other names of the type. Highlighted, background and border change places.
STYLES = """
Project | Project 项目 | #0f172a | #0ea5e9 | #38bdf8 | PROJECT
Version | Version 版本 | #0f172a | #22d3ee | #67e8f9 | VERSION
Commit | Commit 提交 | #0f172a | #f97316 | #fb923c | COMMIT
File | File 文件 | #0f172a | #6366f1 | #818cf8 | FILE
Directory | Directory 目录 | #0f172a | #6b7280 | #9ca3af | DIRECTORY
Module | Module 模块 | #0f172a | #8b5cf6 | #a855f7 | MODULE
Class | Class 类 | #0f172a | #14b8a6 | #2dd4bf | CLASS
Struct | Struct 结构体 | #e0f2f1 | #0f766e | #14b8a6 | STRUCT
Trait | Trait 特征 | #0f172a | #059669 | #34d399 | TRAIT
Function | Function 函数 | #0f172a | #ef4444 | #f87171 | FUNCTION
Method | Method 方法 | #f8fafc | #dc2626 | #f87171 | METHOD
Interface | Interface 接口 | #0f172a | #2563eb | #3b82f6 | INTERFACE
Enum | Enum 枚举 | #0f172a | #fbbf24 | #fcd34d | ENUM
Package | Package 包 | #0f172a | #9333ea | #a855f7 | PACKAGE
Call | Call 调用 | #0f172a | #f59e0b | #fbbf24 | CALL
ReadmeChunk | README 片段 | #0f172a | #facc15 | #fde047 | README_CHUNK, README
CodeChunk | Code 片段 | #0f172a | #22c55e | #4ade80 | CODE_CHUNK
Vector | 向量表示 | #3b0764 | #e879f9 | #f0abfc | VECTOR, EMBEDDING
Default | 其他 | #e2e8f0 | #475569 | #94a3b8 |
"""


def type_styles() -> list[dict]:
    """One entry per type, in the order they are shown."""
    out = []
    for line in STYLES.strip().splitlines():
        kind, name, font, back, border, others = (x.strip() for x in line.split("|"))
        color = {"background": back, "border": border, "highlight_background": border, "highlight_border": back}
        aliases = [x.strip() for x in others.split(",") if x.strip()]
        out.append({"entity_type": kind, "display_name": name, "font_color": font, "color": color} | ({"aliases": aliases} if aliases else {}))
    return out
