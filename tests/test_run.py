import wave

import pytest

from reelquarry.plans import run
from reelquarry.plans.media import open_media
from reelquarry.sources import builder
from reelquarry.sources.builder import Event, Song
from tests.test_media import pcm, replay, samples


@pytest.fixture(scope="module")
def source(tmp_path_factory, spark):
    """A song with a stereo pair whose takes end at different places and leave gaps, a third track, and a clean second song."""
    takes = {1: pcm(100 * 16, 1), 2: pcm(37 * 16, 2), 3: pcm(9000 * 16, 3)}
    long = [Event(12 + a, 12 + a + n, 1 + (t + k) % 3, track=t) for t in (1, 2) for k, (a, n) in enumerate([(3, 60), (200, 90), (400, 8000)])]
    song = Song(3, "PAIR", [*long, Event(12, 30, 1, track=4)], takes)
    clean = Song(4, "CLEAN", [Event(12, 112, 1), Event(20, 25, 0)], {1: takes[1]})
    folder = tmp_path_factory.mktemp("run")
    (folder / "d.bin").write_bytes(builder.raw(builder.archive_stream([song, clean])))
    return open_media(spark, [str(folder / "d.bin")]), song, clean


def test_stereo(source, tmp_path):
    media, song, _ = source
    done = run.extract(media, str(tmp_path / "o"), stereo=True)
    assert [m.removeprefix(str(tmp_path)) for m in done.manifest] == ["/o/03 - PAIR/T1+2-V1.wav", "/o/03 - PAIR/T4-V1.wav", "/o/04 - CLEAN/T1-V1.wav"]
    assert done.status == run.DEVIATIONS and done.n_songs == 2 and all("shorter than its event" in x for x in done.lines)
    with wave.open(done.manifest[0]) as w:
        assert w.getnchannels() == 2
        both = samples(w.readframes(w.getnframes()), 2)
    for k, track in enumerate((1, 2)):
        assert both[k::2].tolist() == replay(song, "VR9", (track, 1)).tolist()


def test_strict(source, tmp_path):
    media = source[0]
    done = run.extract(media, str(tmp_path / "o"), strict=True)
    assert done.status == run.DEVIATIONS and len(done.lines) == 1 and done.lines[0].startswith("deviation [warning §10] song 3 T") and not (tmp_path / "o").exists()
    done = run.extract(media.select([(0, 4)]), str(tmp_path / "o"), strict=True)
    assert done.status == run.CLEAN and len(done.manifest) == 1 and not done.lines


def test_lines(source):
    media = source[0]
    assert [x.split("\t") for x in run.catalog_lines(media)] == [["3", "3", "VR9", "3", "0:03", "-", "-", "-", "PAIR"], ["4", "4", "VR9", "1", "0:00", "-", "-", "-", "CLEAN"]]
    lines, notes = run.detail_lines(media, ["4", "7"])
    assert lines == ["4\t1\t1\t2\t0:00\t-\t-\t"] and notes == ["no song 7 on this source"]


def test_keys():
    assert run.parse_keys(["2.7, 02.007,", "7"]) == [(2, 7), (2, 7), (0, 7)]
    for bad in ("x", "1.2.3", "0.4", "-1", "1."):
        with pytest.raises(ValueError):
            run.parse_keys([bad])
