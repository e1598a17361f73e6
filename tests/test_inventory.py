"""What series definitions say of order books, and the choice of futures."""

import struct

from orderloom import __main__ as cli
from orderloom.sources import omd
from test_sources import message, record


def base(book, symbol, kind, decimals, expiry):
    return message(303, struct.pack("<I32sBHBi8sHBx", book, symbol.encode().ljust(32), kind, decimals, 0, 0, expiry.encode(), 0, 0))


def extended(book, symbol):
    return message(304, struct.pack("<I32s", book, symbol.encode().ljust(32)) + b"\0" * 64)


def test_inventory(spark, tmp_path, capsys, monkeypatch):
    rows = [base(1, "HSIG6", 3, 0, "20260226"), base(2, "HSI20000B6", 1, 0, "20260226"), base(3, "HSIH6", 3, 0, "2026----"), base(4, "MHIG6", 99, 2, "20260330"), base(0, "NONE", 3, 0, "20260226")]
    (tmp_path / "MC101_All_20260102").write_bytes(record(1, *rows))
    (tmp_path / "MC151_All_20260102").write_bytes(record(1, extended(1, "OTHER"), extended(5, "MCHG6")))
    path = str(tmp_path / "MC*")
    found = {r.orderbook_id: r for r in omd.inventory(cli._read(spark, "series", path)).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    shown = lambda r: (r.symbol, r.product_type, r.product_type_name, r.decimals, r.expiry, r.is_future, r.msg_type, r.channel, r.part)
    assert shown(found[1]) == ("HSIG6", 3, "Future", 0, "20260226", True, 303, "MC101", "Partition1")
    assert shown(found[4]) == ("MHIG6", 99, "Unknown(99)", 2, "20260330", False, 303, "MC101", "Partition1")
    assert shown(found[5]) == ("MCHG6", None, None, None, None, False, 304, "MC151", "OAPI")
    assert found[3].expiry is None
    definitions = cli._read(spark, "series", path)
    assert sorted(r.orderbook_id for r in omd.series(definitions, futures_only=True).collect()) == [1, 3, 5]
    classes = {r.class_code: r for r in omd.instruments(definitions).collect()}
    hsi = classes["HSI"]
    assert (hsi.n_books, hsi.n_symbols, hsi.n_futures, hsi.n_options, hsi.n_other, hsi.decimals, hsi.first_expiry, hsi.channels) == (3, 3, 2, 1, 0, "0", "20260226", "MC101")
    assert (classes["MCH"].n_other, classes["MCH"].decimals, classes["MCH"].first_expiry) == (1, "", None)
    monkeypatch.setattr(cli.session, "build", lambda master=None: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    cli.main(["explore", path, "--csv", str(tmp_path / "csv")])
    assert "HSI" in capsys.readouterr().out and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5
