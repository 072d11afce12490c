"""Published or tool-computed positions by projection: definition, latitude, longitude (degrees), x, y, tolerance."""

#: Positions of the literature and of the test collections that the projections are published with.
GOLDEN = [
    ('btmerc k_0=0.9996 lon_0=9 x_0=500000', 55.0, 12.0, 691875.632139661, 6098907.825005012, 0.005),
    ('butm zone=32', 55.0, 12.0, 691875.632139661, 6098907.825005012, 0.005),
    ('calcofi ellps=GRS80', 1.0, 2.0, 508.44487215, -1171.764860418, 1e-06),
    ('col_urban lat_0=4.68048611111111 lon_0=-74.1465916666667 x_0=92334.879 y_0=109320.965 h_0=2550 ellps=GRS80', 4.8, -74.25, 80859.033, 122543.174, 0.001),
    ('eqc ellps=WGS84', 47.0, 2.0, 222638.98158654713, 5207247.008955783, 1e-06),
    ('eqc ellps=WGS84 lat_ts=30 lat_0=10 lon_0=1 x_0=100 y_0=200', 50.0, 3.0, 193072.560501793, 4435192.208449775, 1e-05),
    ('eqc ellps=6371000,0 lat_ts=60', 30.0, 10.0, 555974.6332227937, 3335847.7993367617, 1e-06),
    ('eqc a=6400000', 1.0, 2.0, 223402.144255274, 111701.072127637, 1e-06),
    ('eqearth lon_0=-90 ellps=WGS84', 0.0, -90.0, 0.0, 0.0, 1e-06),
    ('gstmerc ellps=6400000,0', 1.0, 2.0, 223413.466406322, 111769.145040586, 1e-06),
    ('guam_aeqd ellps=clrk66 x_0=50000 y_0=50000 lon_0=144.74875069444445 lat_0=13.47246633333333', 13.33903846111111, 144.63533129166666, 37712.48225814728, 35242.00328956649, 1e-06),
    ('krovak lat_0=49.5 lon_0=24.8333333333333 alpha=30.2881397527778 k=0.9999 x_0=0 y_0=0 ellps=bessel', 50.0833, 14.417, -743263.65590714, -1043505.8365424983, 1e-06),
    ('krovak axis=swu lat_0=49.5 lon_0=24.8333333333333 alpha=30.2881397527778 k=0.9999 x_0=0 y_0=0 ellps=bessel', 50.0833, 14.417, 1043505.8365424983, 743263.65590714, 1e-06),
    ('mod_krovak lat_0=49.5 lon_0=24.8333333333333 alpha=30.2881397222222 k=0.9999 x_0=5000000 y_0=5000000 ellps=bessel', 50.0833, 14.417, -5743263.678112479, -6043505.81123234, 1e-06),
    ('labrd ellps=GRS80 lon_0=0.5 lat_0=2', 1.0, 2.0, 166973.166090228, -110536.912730266, 1e-06),
    ('lcca ellps=GRS80 lat_0=1 lat_1=0.5 lat_2=2', 1.0, 2.0, 222605.285770237, 67.806007272, 1e-06),
    ('mill a=6400000', 1.0, 2.0, 223402.144255274, 111704.701754394, 1e-06),
    ('moll a=6400000', 1.0, 2.0, 201113.698641813, 124066.28343386, 1e-06),
    ('ocea a=6400000 lat_1=0.5 lat_2=2 lon_1=0 lon_2=0', 1.0, 2.0, 19994423.837934088, 223322.760576728, 2e-06),
    ('ortho R=1 lat_0=0 lon_0=0', 50.0, 10.0, 0.1116, 0.766, 0.0001),
    ('ortho ellps=WGS84 lat_0=55 lon_0=5', 53.80939444444444, 2.12955, -189011.711, -128640.567, 0.002),
    ('ortho lat_0=37.628969166666664 lon_0=-122.39394166666668 k_0=0.9999968 alpha=27.7927777777777 x_0=0 y_0=0 ellps=GRS80', 37.62607694444444, -122.3846388888889, 876.13676, 98.97406, 0.0002),
    ('poly lat_0=0 lon_0=-54 x_0=5000000 y_0=10000000 ellps=GRS80', 0.0, -54.0, 5000000.0, 10000000.0, 1e-06),
    ('robin a=6400000', 1.0, 2.0, 189588.423282508, 107318.530350703, 1e-06),
    ('sinu ellps=GRS80', 1.0, 2.0, 222605.299539466, 110574.388554153, 1e-06),
    ('tcea a=6400000', 1.0, 2.0, 223322.760576727, 111769.145040586, 1e-06),
    ('tpeqd ellps=GRS80 lat_1=0.5 lat_2=2', 1.0, 2.0, -27750.758831679, -222599.403691777, 0.001),
    ('aea lat_0=23 lon_0=-96 lat_1=29.5 lat_2=45.5 x_0=1234 y_0=5678 ellps=GRS80', 35.0, -75.0, 1886662.3905428394, 1541647.2858012677, 1e-06),
    ('aea lat_0=40 lon_0=0 lat_1=20 lat_2=60 ellps=6378136.6,0', 35.0, 10.0, 863038.3801426861, -543990.8401591227, 1e-06),
    ('aea lat_0=50 lon_0=-154 lat_1=55 lat_2=65 ellps=clrk66', 60.0, 179.0, -1459959.1500543347, 1413239.94813774, 1e-06),
    ('aea ellps=GRS80 lat_1=89.9999999945 lat_2=60', 10.0, 10.0, 1375346.09940711, 956821.8536629752, 1e-06),
    ('aeqd lat_0=52 lon_0=-97.5 x_0=8264722.177 y_0=4867518.353 ellps=WGS84', 61.390407158824, -101.971128034161, 8024875.974381589, 5920866.113963526, 1e-06),
    ('aeqd R=6400000 lat_0=30 lon_0=20 x_0=1000 y_0=2000', 40.0, 25.0, 430838.560011896, 1129341.9380514754, 1e-06),
    ('aeqd ellps=WGS84 lat_0=90 lon_0=15 x_0=3000 y_0=4000', 80.0, 20.0, 100337.78711938244, -1108575.9978095905, 1e-06),
    ('aeqd R=6400000 lat_0=90 lon_0=15 x_0=3000 y_0=4000', 80.0, 20.0, 100353.8990699395, -1108760.1582471575, 1e-06),
    ('aeqd R=6400000 lat_0=0 lon_0=0', 0.0, 175.0, 19547687.622336593, 0.0, 1e-06),
    ('aeqd ellps=WGS84 lat_0=0 lon_0=0 x_0=100 y_0=200', 0.0, 10.0, 1113294.9079327357, 200.0, 1e-06),
    ('cass lat_0=31.7340969444444 lon_0=35.2120805555556 x_0=170251.555 y_0=126867.909 ellps=6378300.789,293.4663155389811', 31.7340969444444, 35.2120805555556, 170251.555, 126867.909, 1e-06),
    ('cass hyperbolic lat_0=-16.25 lon_0=179.333333333333 x_0=251727.9155424 y_0=334519.953768 ellps=6378306.3696,293.4663076567816', -16.1, -179.5, 376542.2427427354, 350765.38523137424, 5e-05),
    ('cea ellps=GRS80 lon_0=7 x_0=1234 y_0=5678', 1.0, 2.0, -555363.4539663679, 116246.81239626753, 1e-06),
    ('cea R=6400000 lat_ts=0 lon_0=7 x_0=1234 y_0=5678', 1.0, 2.0, -557271.3606381855, 117373.40119861448, 1e-06),
    ('eqdc ellps=GRS80 lat_1=0.5 lat_2=2', 1.0, 2.0, 222588.440269286, 110659.134907347, 1e-06),
    ('eqdc ellps=6378136.6,0 lat_0=10 lat_1=20 lat_2=60 lon_0=5', 35.0, 15.0, 860776.2204604275, 2830344.4092038227, 1e-06),
    ('eqdc ellps=GRS80 lat_1=89.9999999945 lat_2=60', 10.0, 10.0, 1475877.20480114, 1229134.0569107984, 1e-06),
    ('laea ellps=GRS80 lat_0=52 lon_0=10 x_0=4321000 y_0=3210000', 50.0, 5.0, 3962799.4509550678, 2999718.853159564, 1e-06),
    ('laea lon_0=10 lat_0=52 x_0=4321000 y_0=3210000', 52.0, 10.0, 4321000.0, 3210000.0, 1e-06),
    ('laea ellps=GRS80 lat_0=90 lon_0=0 x_0=0 y_0=0', 20.0, 80.0, 7204871.251665172, -1270413.1941993393, 1e-06),
    ('laea ellps=GRS80 lat_0=-90 lon_0=0 x_0=0 y_0=0', -45.0, -70.0, -4594471.834923999, 1672250.990086757, 1e-06),
    ('laea ellps=6378136.6,0 lat_0=90 lon_0=0 x_0=0 y_0=0', 20.0, 80.0, 7205540.644230844, -1270531.226169353, 1e-06),
    ('laea ellps=GRS80', 1.0, 2.0, 222602.47145009518, 110589.82722441046, 1e-06),
    ('laea R=1 lat_0=45', 45.0, 45.0, 0.5193766873761451, 0.15212190974226733, 1e-06),
    ('laea ellps=GRS80 lat_0=90', 45.0, 0.0, 0.0, -4889334.8029927425, 1e-06),
    ('lcc lat_1=57 lon_0=12', 55.0, 10.0, -128046.47243865224, -220853.7001605064, 1e-06),
    ('lcc lat_1=33 lat_2=45 lon_0=10', 40.0, 12.0, 169863.0260939383, 4735925.219292451, 1e-06),
    ('lcc lat_1=39 lat_0=35 lon_0=10', 40.0, 12.0, 170800.01172874065, 557172.3611129294, 1e-06),
    ('lcc lat_1=33 lat_2=45 lat_0=35 lon_0=10', 40.0, 12.0, 169863.02609393836, 554155.4407939166, 1e-06),
    ('lcc lat_1=33 lat_2=45 lat_0=35 lon_0=10 x_0=12345 y_0=67890', 40.0, 12.0, 182208.0260939383, 622045.4407939166, 1e-06),
    ('lcc lat_1=33 lat_2=45 lat_0=35 lon_0=10 x_0=12345 y_0=67890 k_0=0.99', 40.0, 12.0, 180509.3958329989, 616503.8863859775, 1e-06),
    ('merc', 55.0, 12.0, 1335833.8895192828, 7326837.714873877, 1e-06),
    ('merc lat_ts=56', 55.0, 12.0, 748713.2579258868, 4106573.8628412704, 1e-06),
    ('merc lat_ts=-41 lon_0=100 x_0=1234 y_0=5678 ellps=WGS84', -33.0, 141.0, 3450776.589676943, -2920802.103023605, 1e-06),
    ('merc lon_0=13.5', 45.0, 13.5, 0.0, 5591295.918405316, 1e-06),
    ('merc ellps=6356751.9,0', 0.180267173822635, 0.090133735615956, 10000.00000000005, 19999.99999999998, 1e-06),
    ('omerc ellps=evrstSS variant x_0=590476.87 y_0=442857.65 latc=4 lonc=115 k_0=0.99984 alpha=53:18:56.9537 gamma_c=53:07:48.3685', 5.3872535833, 115.8055054444, 679245.7281740266, 596562.7774687681, 1e-06),
    ('stere ellps=GRS80 lat_0=45 lon_0=10 k_0=0.9999', 50.0, 12.0, 143683.51855326936, 558126.8639123037, 1e-06),
    ('stere ellps=GRS80 lat_0=0 lon_0=5 k_0=1 x_0=100 y_0=200', 15.0, 10.0, 547504.2826656469, 1671859.2083782128, 1e-06),
    ('stere ellps=GRS80 lat_0=90 lat_ts=70 lon_0=0', 80.0, 20.0, 371406.61576060014, -1020431.2902383083, 1e-06),
    ('stere ellps=GRS80 lat_0=-90 lat_ts=-70 lon_0=0', -80.0, -20.0, -371406.61576060014, 1020431.2902383083, 1e-06),
    ('stere lat_0=-90 lat_ts=-67 lon_0=140 x_0=300000 y_0=200000 ellps=intl', -66.60522777777778, 140.0714, 303169.5218569705, 2743419.2083312683, 1e-06),
    ('stere lat_0=90 lat_ts=67 lon_0=140 x_0=300000 y_0=200000 ellps=intl', 66.60522777777778, 140.0714, 303169.5218569705, -2343419.2083312683, 1e-06),
    ('stere R=6378136.6 lat_0=45 lon_0=10 k_0=0.9999', 50.0, 12.0, 143358.8095363526, 558741.8950450143, 1e-06),
    ('stere R=6378136.6 lat_0=90 lat_ts=70 lon_0=0', 80.0, 20.0, 370194.70004914806, -1017101.5791868112, 1e-06),
    ('stere R=6378136.6 lat_0=90 lon_0=0', 80.0, 20.0, 381704.4990346518, -1048724.4920019445, 1e-06),
    ('stere lat_0=90 lon_0=10 x_0=123 y_0=456 ellps=GRS80', 80.0, 20.0, 194551.50781453418, -1102202.8615839677, 1e-06),
    ('sterea lat_0=52.1666666666667 lon_0=19.1666666666667 k_0=0.999714 x_0=500000 y_0=500000 ellps=krass', 52.1666666666667, 19.1666666666667, 500000.0, 500000.0, 1e-06),
    ('sterea lat_0=52.1666666666667 lon_0=19.1666666666667 k_0=0.999714 x_0=500000 y_0=500000 ellps=krass', 49.734897261834, 19.151997685019, 498942.3343743173, 229504.5906664739, 1e-06),
    ('tmerc k_0=0.9996 lon_0=9 x_0=500000', 55.0, 12.0, 691875.632139661, 6098907.825005012, 1e-06),
    ('utm zone=32', 55.0, 12.0, 691875.632139661, 6098907.825005012, 1e-06),
    ('ups ellps=WGS84', 85.0, 0.0, 2000000.0, 1444542.6086173225, 1e-06),
    ('ups south ellps=WGS84', -85.0, 0.0, 2000000.0, 2555457.3913826775, 1e-06),
    ('ups ellps=intl', 85.0, 5.0, 2048413.8908028326, 1446626.6959434473, 1e-06),
    ('webmerc', 55.0, 12.0, 1335833.8895192828, 7361866.113051188, 1e-06),
    ('webmerc lon_0=10 x_0=100 y_0=200', 49.0, 12.0, 222738.9815865471, 6275061.394006575, 1e-06),
]
