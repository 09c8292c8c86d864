"""Tables in the shared folder: the session's setting while several threads write."""

import threading

from loomtrace.operators.storage import CLEANUP, own_shuffles, stored


def test_threads_of_one_session_restore_the_setting(spark):
    before = spark.conf.get(CLEANUP, "false")
    first_in, second_out = threading.Event(), threading.Event()
    seen = []

    def outer():
        with own_shuffles(spark):
            first_in.set()
            second_out.wait(10)
            seen.append(spark.conf.get(CLEANUP))

    thread = threading.Thread(target=outer)
    thread.start()
    assert first_in.wait(10)
    with own_shuffles(spark):
        seen.append(spark.conf.get(CLEANUP))
    second_out.set()
    thread.join()
    assert seen == ["true", "true"] and spark.conf.get(CLEANUP, "false") == before


def test_the_setting_is_restored_when_a_write_fails(spark):
    before = spark.conf.get(CLEANUP, "false")
    try:
        stored(spark.range(3).selectExpr("raise_error('no') AS x"), "failing")
    except Exception:  # noqa: BLE001
        pass
    assert spark.conf.get(CLEANUP, "false") == before
    assert stored(spark.range(3), "fine").count() == 3
