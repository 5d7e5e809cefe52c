"""Connections: a current database, transactions one at a time, listeners."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from .db import Db, empty_db, init_db
from .schema import Schema
from .tx import Datom, TxReport, with_tx


class Conn:
    def __init__(self, db: Db, store: Any = None) -> None:
        self._db, self._lock, self.listeners, self._keys, self.store = db, threading.RLock(), {}, itertools.count(), store

    @property
    def db(self) -> Db:
        return self._db

    def transact(self, tx_data: Any, tx_meta: Any = None) -> TxReport:
        """Applies a transaction, stores it, and calls the listeners."""
        with self._lock:
            report = with_tx(self._db, tx_data, tx_meta)
            self._db = report.db_after
            if self.store is not None and report.tx_data:
                self.store.append(report)
            self._tell(report)
            return report

    def transact_async(self, tx_data: Any, tx_meta: Any = None) -> Future:
        return _pool.submit(self.transact, tx_data, tx_meta)

    def reset(self, db: Db, tx_meta: Any = None) -> TxReport:
        """Puts another database in place; its report retracts all old facts and adds all new ones."""
        with self._lock:
            before, self._db = self._db, db
            data = [Datom(d.e, d.a, d.v, d.tx, False) for d in before] + list(db)
            report = TxReport(before, db, data, {}, tx_meta)
            if self.store is not None:
                self.store.store(db)
            self._tell(report)
            return report

    def reset_schema(self, schema: dict) -> Schema:
        with self._lock:
            self._db = self._db.with_schema(schema)
            return self._db.schema

    def listen(self, callback: Callable[[TxReport], None], key: Any = None) -> Any:
        key = next(self._keys) if key is None else key
        self.listeners[key] = callback
        return key

    def unlisten(self, key: Any) -> None:
        self.listeners.pop(key, None)

    def _tell(self, report: TxReport) -> None:
        for f in list(self.listeners.values()):
            f(report)


_pool = ThreadPoolExecutor(1)


def create_conn(schema: dict | None = None, store: Any = None) -> Conn:
    return Conn(empty_db(schema), store)


def conn_from_db(db: Db) -> Conn:
    return Conn(db)


def conn_from_datoms(datoms: Any, schema: dict | None = None) -> Conn:
    return Conn(init_db(datoms, schema))
