"""Calls from workers back to the driver, over one authenticated connection a worker process.

A repeated task repeats its calls: delivery is at least once.
"""

from __future__ import annotations

import secrets
import threading
from collections.abc import Callable
from multiprocessing.connection import Client, Connection, Listener
from typing import Any

_open: dict[tuple, Connection] = {}
_lock = threading.Lock()


class RemoteCallback:
    """What a worker holds in place of the driver's function."""

    def __init__(self, address: tuple[str, int], secret: bytes, name: str):
        self.address, self.secret, self.name = address, secret, name

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        with _lock:
            key = (self.address, self.secret)
            if key not in _open:
                _open[key] = Client(self.address, authkey=self.secret)
            _open[key].send((self.name, args, kwargs))
            fine, out = _open[key].recv()
        if not fine:
            raise RuntimeError(out)
        return out


class CallbackServer:
    """Serves functions of the driver to workers that know the secret."""

    def __init__(self, host: str = "127.0.0.1"):
        self.secret = secrets.token_bytes(32)
        self.listener = Listener((host, 0), authkey=self.secret)
        self.functions: dict[str, Callable] = {}
        threading.Thread(target=self._accept, daemon=True).start()

    def register(self, fn: Callable) -> RemoteCallback:
        name = secrets.token_hex(8)
        self.functions[name] = fn
        return RemoteCallback(self.listener.address, self.secret, name)

    def _accept(self) -> None:
        while True:
            try:
                connection = self.listener.accept()
            except OSError:
                return
            except Exception:  # a client without the secret
                continue
            threading.Thread(target=self._serve, args=(connection,), daemon=True).start()

    def _serve(self, connection: Connection) -> None:
        try:
            while True:
                name, args, kwargs = connection.recv()
                try:
                    connection.send((True, self.functions[name](*args, **kwargs)))
                except Exception as e:
                    connection.send((False, repr(e)))
        except (EOFError, OSError):
            connection.close()

    def close(self) -> None:
        self.listener.close()


_server: list[CallbackServer] = []


def remote(spark: Any, fn: Callable) -> RemoteCallback:
    """One server for a driver process, on the address that executors reach the driver by."""
    if not _server:
        _server.append(CallbackServer(spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")))
    return _server[0].register(fn)
