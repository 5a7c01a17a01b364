"""Grading of code answers in processes that they cannot leave. Off unless asked for.

A server process, one for a partition, forks a child for each answer. The child
gets the code and the arguments of the tests, never what is expected; it hands
back values, and the comparison is made outside. A child has a session of its
own, no rights where the server is root, limits on CPU, memory, descriptors,
processes and the size of files, and is killed with its whole group when its
time is over or its answer is there.
"""

from __future__ import annotations

import json
import re
import subprocess
import sys
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.shipping import ship

#: Bytes that an answer may hand back, bytes of a file that it may write, user without rights, graded answers that a task remembers.
MOST_BYTES, FILE_BYTES, NOBODY, REMEMBERED = 1 << 20, 1 << 20, 65534, 4096

_SERVER = r"""
import contextlib, copy, io, json, os, resource, select, signal, sys, time

seconds, memory, most, file_bytes, nobody = float(sys.argv[1]), *map(int, sys.argv[2:6])


def plain(x, depth=0):
    # values as JSON with the kinds that JSON lacks; what has another kind equals nothing
    kind = type(x)
    if x is None or kind in (bool, int, float, str):
        return x
    if depth < 50:
        if kind in (list, tuple):
            return {kind.__name__: [plain(y, depth + 1) for y in x]}
        if isinstance(x, dict):
            return {"dict": [[plain(k, depth + 1), plain(v, depth + 1)] for k, v in dict.items(x)]}
    return {"other": kind.__name__}


def answer(job):
    space, got = {}, []
    with contextlib.redirect_stdout(io.StringIO()):
        try:
            exec(job["code"], space)
        except BaseException as error:
            return {"error": type(error).__name__}
        target = space.get(job["fn"])
        if not callable(target):
            return {"missing": True}
        for args in job["args"]:
            try:
                got.append([plain(target(*copy.deepcopy(args)))])
            except BaseException:
                got.append([])
    return {"got": got}


def child(job, out):
    os.setsid()
    null = os.open(os.devnull, os.O_RDWR)
    for to in (0, 1, 2):
        os.dup2(null, to)
    os.dup2(out, 3)
    os.closerange(4, 1024)
    cpu = max(1, int(seconds))
    if os.getuid() == 0:
        os.setgroups([])
        os.setresgid(nobody, nobody, nobody)
    limits = ((resource.RLIMIT_CPU, cpu), (resource.RLIMIT_AS, memory), (resource.RLIMIT_FSIZE, file_bytes), (resource.RLIMIT_NOFILE, 16), (resource.RLIMIT_CORE, 0), (resource.RLIMIT_NPROC, 0))
    for limit, value in limits:
        resource.setrlimit(limit, (value, value))
    if os.getuid() == 0:
        os.setresuid(nobody, nobody, nobody)
    data = json.dumps(answer(job)).encode()
    while data:
        data = data[os.write(3, data):]


for line in sys.stdin.buffer:
    job = json.loads(line)
    read, write = os.pipe()
    pid = os.fork()
    if not pid:
        try:
            child(job, write)
        finally:
            os._exit(0)
    os.close(write)
    data, until, late = b"", time.monotonic() + seconds, False
    while len(data) <= most:
        ready = select.select([read], [], [], max(0, until - time.monotonic()))[0]
        if not ready:
            late = True
            break
        part = os.read(read, 65536)
        if not part:
            break
        data += part
    os.close(read)
    for kill in (os.killpg, os.kill):
        with contextlib.suppress(OSError):
            kill(pid, signal.SIGKILL if late or len(data) > most else signal.SIGTERM if kill is os.kill else signal.SIGKILL)
    status = os.waitpid(pid, 0)[1]
    try:
        result = json.loads(data)
        assert isinstance(result, dict)
    except Exception:
        killed = os.WIFSIGNALED(status) and os.WTERMSIG(status) in (signal.SIGXCPU, signal.SIGKILL)
        result = {"error": "TimeoutError" if late else "SystemExit" if not data else "OutputError"} if not killed or late or data else {"error": "TimeoutError"}
    print(json.dumps(result), flush=True)
"""


class Sandbox:
    """A server for answers; started when it is needed, and again if it was lost."""

    def __init__(self, timeout: float = 5.0, memory: int = 512 << 20):
        self.timeout, self.memory, self.process = timeout, memory, None
        self._seen: OrderedDict[tuple[str, str, bool], tuple] = OrderedDict()

    def __enter__(self) -> Sandbox:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.process:
            self.process.kill()
            self.process.communicate()
            self.process = None

    def _run(self, job: dict) -> dict:
        if self.process is None:
            limits = map(str, (self.timeout, self.memory, MOST_BYTES, FILE_BYTES, NOBODY))
            self.process = subprocess.Popen([sys.executable, "-I", "-S", "-c", _SERVER, *limits], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={}, start_new_session=True)
        try:
            self.process.stdin.write(json.dumps(job).encode() + b"\n")
            self.process.stdin.flush()
            line = self.process.stdout.readline()
            return json.loads(line)
        except (OSError, ValueError):  # the server is gone
            self.close()
            return {"error": "SandboxLost"}

    def grade(self, output: str, code_tests: str, *, review: bool = False) -> tuple[bool, str | None, list[str]]:
        """(correct, ``k/n tests passed`` or null, flags) of one answer; ``review``: older rule sets also flag a missing function for review."""
        if not output or not output.strip():
            return False, None, ["empty_output"]
        key = (output, code_tests, review)
        if key not in self._seen:
            self._seen[key] = self._judge(output, json.loads(code_tests), review)
            if len(self._seen) > REMEMBERED:
                self._seen.popitem(last=False)
        return self._seen[key]

    def _judge(self, output: str, tests: dict, review: bool) -> tuple[bool, str | None, list[str]]:
        result = self._run({"code": re.sub(r"```(?:python)?", "", output), "fn": tests["fn"], "args": [args for args, _ in tests["tests"]]})
        n = len(tests["tests"])
        if result.get("missing"):
            return False, None, ["function_not_defined", *["needs_review"] * review]
        got = result.get("got")
        if not isinstance(got, list) or len(got) != n:
            return False, None, [f"exec_error: {result.get('error', 'OutputError')}"]
        passed = sum(_equal(value, expected) for value, (_, expected) in zip(got, tests["tests"], strict=True))
        return passed == n, f"{passed}/{n} tests passed", []


class _Other:
    """A value of a kind that no expected value has."""


def _value(x: object) -> object:
    """A value as the child wrote it down; malformed ones equal nothing."""
    if not isinstance(x, dict):
        return x
    [(kind, inner)] = x.items()
    if kind == "dict":
        return {_value(k): _value(v) for k, v in inner}
    return {"list": list, "tuple": tuple}[kind](map(_value, inner)) if kind in ("list", "tuple") else _Other()


def _equal(answer: object, expected: object) -> bool:
    try:
        [written] = answer
        value = _value(written)
        return bool(value == expected or (isinstance(value, tuple) and list(value) == expected))
    except Exception:  # noqa: BLE001  whatever the child wrote, it is no pass
        return False


def grade_code(output: str, code_tests: str, *, timeout: float = 5.0, memory: int = 512 << 20, review: bool = False) -> tuple[bool, str | None, list[str]]:
    """``Sandbox.grade`` of one answer in a sandbox of its own."""
    with Sandbox(timeout, memory) as sandbox:
        return sandbox.grade(output, code_tests, review=review)


def grade_code_rows(df: DataFrame, *, enabled: bool = False, review: bool = False) -> DataFrame:
    """Adds ``code_grade`` (correct, extracted, flags) to rows with ``completion_text`` and ``code_tests``. Equal answers next to each other in a partition run once."""
    if not enabled:
        raise PermissionError("model output is only executed with enabled=True")

    ship(df.sparkSession)

    def rows(parts):
        import pandas as pd

        with Sandbox() as sandbox:
            for outputs, tests in parts:
                graded = [sandbox.grade(o or "", t, review=review) for o, t in zip(outputs, tests, strict=True)]
                yield pd.DataFrame(graded, columns=["correct", "extracted", "flags"])

    kind = "struct<correct:boolean,extracted:string,flags:array<string>>"
    grade = F.pandas_udf(rows, kind, functionType=F.PandasUDFType.SCALAR_ITER)
    return df.withColumn("code_grade", grade("completion_text", "code_tests"))
