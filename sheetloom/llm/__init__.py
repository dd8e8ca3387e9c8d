"""Operations of a training-data pipeline.

Nothing else in the library imports this subpackage; its queries are gathered in
:mod:`sheetloom.llm.queries`.
"""
