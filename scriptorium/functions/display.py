"""What people see of jobs and records: labels of states, errors in plain words, and records as flat rows of fields."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Labels of states (fixed values).
STATUS = {"queued": "В очереди", "processing": "Обработка", "done": "Готово", "failed": "Ошибка"}
#: Messages by what an error's text holds, in the order in which they are tried; of a tuple's parts all must be there (fixed values).
ERRORS = (
    (("could not", "extract"), "Модель не смогла извлечь данные из документа. Попробуйте другой файл или повторный запуск."),
    (("не смогла извлечь поля",), "Модель не смогла извлечь данные из документа. Попробуйте другой файл или повторный запуск."),
    (("зациклилась при генерации",), "Модель зациклилась при генерации ответа. Попробуйте повторить запуск или выбрать другой документ."),
    (("loop",), "Модель зациклилась при генерации ответа. Попробуйте повторить запуск или выбрать другой документ."),
    (("repetition",), "Модель зациклилась при генерации ответа. Попробуйте повторить запуск или выбрать другой документ."),
    (("supports only invoice extraction",), "Текущий движок Donut пока поддерживает только обработку счетов и invoice-документов."),
    (("not wired into the pipeline yet",), "Выбранный движок уже добавлен в архитектуру, но пока не подключен к полному pipeline."),
    (("schema_mapping_not_implemented",), "Текст документа извлечен, но структурный парсинг полей для этого типа документа пока не реализован."),
    (("identity-document parser found too few fields",), "Текст документа считан, но автоматический разбор полей сработал неуверенно."),
    (("unsupported operand type",), "Произошла внутренняя ошибка обработки. Попробуйте повторный запуск."),
    (("not found",), "Запрошенная job не найдена."),
)


def status_label(status: Column) -> Column:
    """The label of a state; others stay as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair)), status), status)


def friendly_error(message: Column) -> Column:
    """The first message whose words an error holds, in any case, else the error itself; null for none."""
    low = F.lower(message)
    out = message
    for parts, said in reversed(ERRORS):
        test = F.lit(True)
        for p in parts:
            test = test & F.contains(low, F.lit(p))
        out = F.when(test, said).otherwise(out)
    return F.when(F.coalesce(message, F.lit("")) != "", out)


def _said(x: object) -> str:
    """A scalar as a page shows it: booleans and null in small letters, whole numbers without a point."""
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return x if isinstance(x, str) else json.dumps(x)


def _rows(value: object, path: str) -> Iterator[tuple[str, str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _rows(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        if value and not any(isinstance(x, (dict, list)) for x in value):
            yield path, path, ", ".join(map(_said, value))
        else:
            for i, v in enumerate(value):
                yield from _rows(v, f"{path}[{i}]")
    elif value is not None:
        yield path, path.rpartition(".")[2], _said(value)


def _shown(text: str | None) -> list[dict] | None:
    try:
        return None if text is None else [{"path": p, "label_key": k, "value": v} for p, k, v in _rows(json.loads(text), "")]
    except ValueError:
        return None


@pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("path", "label_key", "value")])))
def shown_fields(texts: pd.Series) -> pd.Series:
    """Rows (path, label_key, value) of a record in JSON: nulls and empty lists are left out, lists of scalars are joined by ', ' under their whole path, others are indexed; null if it is no JSON."""
    return texts.map(_shown)
