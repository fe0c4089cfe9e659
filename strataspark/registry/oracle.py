"""SQL counterparts of the registered queries, for DuckDB.

Written from the meaning of each query, over the given tables only.
"""

from __future__ import annotations

import math

from strataspark.mapped import RECHECKED, REMAP_BY, REMAPPED

SQL: dict[str, str] = {}

_KEY = "cast(substr(OBSID, 4) as bigint)"


def _named(keys: range) -> str:
    """Whether an observation's key is one of ``keys``."""
    return f"{_KEY} < {keys.stop} and {_KEY} % {keys.step} = {keys.start}"


RECHECK = f"({_named(RECHECKED)})"
REMAP = f"when {_named(REMAPPED)} then 'OB-' || cast({_KEY} + {REMAP_BY} as varchar)"

PROJECTS = "('1-URGENT','2-HIGH')"

# The field tables over orders and line items.
BASE = """
f_li as (
  select *, (l_orderkey*10 + l_linenumber)*1000000 + (l_partkey*7919 + l_suppkey*104729
           + cast(round(l_extendedprice*100) as bigint)*31) % 1000000 as rid,
         'db'||cast(cast(floor(l_orderkey/5) as bigint)%3 as varchar) as src,
         'TM-'||cast(l_orderkey as varchar)||case when l_linenumber>=6 then '-2' else '-1' end as tmg,
         'OB-'||cast(l_orderkey as varchar) as obk
  from lineitem),
obs as (
  select 'db'||cast(cast(floor(o_orderkey/5) as bigint)%3 as varchar) as src, o_orderkey as orid,
         'OB-'||cast(case when o_orderkey%50 in (45,49) then o_orderkey-1 else o_orderkey end as varchar) as OBSID,
         59.5e0+(o_orderkey*37%1000)/100.0e0 as LAT, 20.0e0+(o_custkey*53%1200)/100.0e0 as LON,
         o_orderstatus as OBS_REMARKS, o_orderpriority as PROJECT
  from orders),
tec as (select src, rid, obk as OBSID, tmg as GDB_ID from f_li where l_linenumber<>4),
pl0 as (
  select src, rid, tmg as TM_GID, l_linestatus as REMARKS,
         case when l_tax=0.08e0 then null else l_quantity*2-5 end as DIP,
         cast((l_partkey*7)%400 as double) as DIRECTION_OF_DIP,
         l_returnflag||l_linestatus as STYPE_TEXT, l_linestatus as FOL_TYPE_TEXT, l_returnflag as STYPE,
         cast(l_linenumber%3 as varchar) as H_SENCE, 'sense '||cast(l_linenumber%3 as varchar) as H_SENCE_TEXT
  from f_li where l_linenumber in (1,2,6)),
pl as (select * from pl0 union all select * replace (rid+500 as rid) from pl0 where rid%17=0),
li as (
  select src, rid, tmg as TM_GID, l_linestatus as REMARKS,
         cast((l_partkey*11)%380 as double) as DIRECTION, l_quantity*2-8 as PLUNGE,
         l_linestatus as STYPE_TEXT, l_returnflag as STYPE
  from f_li where l_linenumber in (2,3,7)),
rk as (
  select src, rid, 'RP-'||cast(rid as varchar) as GDB_ID, obk as OBSID,
         case when l_tax=0e0 then null else 'rock' end as REMARKS,
         l_returnflag as FIELD_NAME, l_linestatus as ROCK_NAME
  from f_li where l_linenumber<=2),
tx as (
  select src, rid, 'RP-'||cast(rid as varchar) as ROP_GID, l_returnflag as ST_1, l_linestatus as ST_2
  from f_li where l_linenumber=1
  union all
  select src, rid+500, 'RP-'||cast(rid as varchar), l_linestatus, l_returnflag
  from f_li where l_linenumber=1 and rid%3=0),
sa as (
  select src, rid, obk as OBSID, 'S-'||cast(rid as varchar) as SAMPLEID, l_returnflag as FIELD_NAME
  from f_li where l_discount>=0.085e0),
im as (
  select src, rid, obk as OBSID,
         'IMG'||cast(case when rid%13=0 then l_orderkey else rid end as varchar) as PICTURE_ID,
         'pic '||cast(l_linenumber as varchar) as REMARKS
  from f_li where l_tax<0.015e0),
files as (
  select 'imgs/'||PICTURE_ID||case when rid%11=0 then '.png' else '.jpg' end as path,
         400+rid%3000 as width, 300+rid%2000 as height
  from im where rid%7<>0)
"""


def _num(value: float) -> str:
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def _series(inverse_flattening: float) -> dict:
    """Series constants of an ellipsoid, in nested form."""
    f = 1 / inverse_flattening
    n = f / (2 - f)
    return {
        "e": math.sqrt(f * (2 - f)),
        "ka": 0.9996 * (6378137.0 / (1 + n) * (1 + n * n / 4 + n**4 / 64)),
        "alpha": (
            n * (1 / 2 + n * (-2 / 3 + n * (5 / 16 + n * 41 / 180))),
            n * n * (13 / 48 + n * (-3 / 5 + n * 557 / 1440)),
            n**3 * (61 / 240 - n * 103 / 140),
            n**4 * 49561 / 161280,
        ),
        "beta": (
            n * (1 / 2 + n * (-2 / 3 + n * (37 / 96 - n / 360))),
            n * n * (1 / 48 + n * (1 / 15 - n * 437 / 1440)),
            n**3 * (17 / 480 - n * 37 / 840),
            n**4 * 4397 / 161280,
        ),
        "delta": (
            n * (2 + n * (-2 / 3 + n * (-2 + n * 116 / 45))),
            n * n * (7 / 3 + n * (-8 / 5 - n * 227 / 45)),
            n**3 * (56 / 15 - n * 136 / 35),
            n**4 * 4279 / 630,
        ),
    }


def _projected(
    source: str,
    name: str,
    inverse_flattening: float = 298.257222101,
    a: float = 6378137.0,
    scale: float = 0.9996,
) -> str:
    """CTEs that add x and y (central meridian 27) to a relation with LAT, LON."""
    c = _series(inverse_flattening)
    c["ka"] *= a / 6378137.0 * scale / 0.9996
    east = "+".join(f"{_num(a)}*cos({2*j}*xi)*sinh({2*j}*eta)" for j, a in enumerate(c["alpha"], 1))
    north = "+".join(f"{_num(a)}*sin({2*j}*xi)*cosh({2*j}*eta)" for j, a in enumerate(c["alpha"], 1))
    e, ka = _num(c["e"]), _num(c["ka"])
    return f"""
{name}_t as (select *, sinh(atanh(sin(radians(LAT)))-{e}*atanh({e}*sin(radians(LAT)))) as t,
    radians(LON-27e0) as dl from {source}),
{name}_r as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl)/sqrt(1e0+t*t)) as eta from {name}_t),
{name} as (select * exclude (t, dl, xi, eta), 500000e0+{ka}*(eta+{east}) as x, {ka}*(xi+{north}) as y from {name}_r)"""


IN_BOX = "x between 150000e0 and 500000e0 and y between 6700000e0 and 7400000e0"

# Selected observations, and everything linked to them.
SELECTED = (
    BASE
    + f", wanted as (select * from obs where PROJECT in {PROJECTS}),"
    + _projected("wanted", "placed")
    + f"""
, sel as (select *, case {REMAP} else OBSID end as tkey from placed where {IN_BOX})"""
)

OWN = "sel.src, sel.orid, sel.OBSID, sel.OBS_REMARKS, sel.PROJECT, sel.LAT, sel.LON, sel.x, sel.y"
PLAIN = "src, orid, OBSID, OBS_REMARKS, PROJECT, LAT, LON, x, y"


def _children(sel: str) -> str:
    """CTEs of all child types linked to the observations ``sel``."""
    own = OWN.replace("sel.", f"{sel}.")
    return f"""
, seen as (select {own}, GDB_ID, min(rid) as first_rid from {sel}
    join tec on tec.src={sel}.src and tec.OBSID={sel}.tkey group by all)
, tect as (select {PLAIN}, max_by(GDB_ID, first_rid) as GDB_ID, count(*) as n_ids from seen group by all)
, planars as (select {PLAIN.replace('src,', 'tect.src,', 1)}, REMARKS, DIP, DIRECTION_OF_DIP, STYPE_TEXT,
    FOL_TYPE_TEXT, STYPE, H_SENCE, H_SENCE_TEXT, min(rid) as rid
    from tect join pl on pl.src=tect.src and pl.TM_GID=tect.GDB_ID group by all)
, linears as (select {PLAIN.replace('src,', 'tect.src,', 1)}, REMARKS, DIRECTION, PLUNGE, STYPE_TEXT, STYPE,
    min(rid) as rid
    from tect join li on li.src=tect.src and li.TM_GID=tect.GDB_ID group by all)
, images as (select {own}, im.PICTURE_ID, im.REMARKS, min(rid) as rid
    from {sel} join im on im.src={sel}.src and im.OBSID={sel}.OBSID group by all)
, samples as (select {own}, sa.SAMPLEID, sa.FIELD_NAME, min(rid) as rid
    from {sel} join sa on sa.src={sel}.src and sa.OBSID={sel}.tkey group by all)
, tuples as (select src, ROP_GID, '('||string_agg(''''||ST_2||'''', ', ' order by rid)
    ||case when count(*)=1 then ',)' else ')' end as ST_2 from tx group by all)
, rocks as (select {own}, rk.REMARKS, rk.FIELD_NAME, rk.ROCK_NAME, tuples.ST_2, min(rk.rid) as rid
    from {sel} join rk on rk.src={sel}.src and rk.OBSID={sel}.OBSID
    left join tuples on tuples.src=rk.src and tuples.ROP_GID=rk.GDB_ID group by all)
, tx_rows as (select {own}, tx.ST_2, tx.ST_1, rk.rid as rid, tx.rid as rid2
    from {sel} join rk on rk.src={sel}.src and rk.OBSID={sel}.OBSID
    join tx on tx.src=rk.src and tx.ROP_GID=rk.GDB_ID)
, textures as (select {PLAIN}, ST_2, ST_1, rid, rid2 from (
    select *, row_number() over (partition by src, orid, ST_2, ST_1 order by rid, rid2) as k
    from tx_rows) where k=1)
"""


LINKED = SELECTED + _children("sel")


def _base(body: str) -> str:
    return f"with {BASE}\n{body}"


def _linked(body: str) -> str:
    return f"with {LINKED}\n{body}"


def _turned(column: str, declination: str) -> str:
    total = f"({column}+{declination})"
    return (
        f"case when not ({column} between 0 and 360) then {column} "
        f"when {total}>360 then {total}-360 when {total}<0 then {total}+360 else {total} end"
    )


# --- filters ---------------------------------------------------------------

SQL["flt1_project_filter"] = _base(
    f"select src, orid as rid, OBSID, PROJECT from obs where PROJECT in {PROJECTS}"
)
SQL["flt1_project_table_filter"] = _base(
    """select src, orid as rid, OBSID, PROJECT from obs
    where PROJECT in (select PROJECT from obs where OBS_REMARKS='P')"""
)
SQL["flt2_bounds_filter"] = (
    f"with {BASE}, {_projected('obs', 'placed')} "
    f"select src, orid as rid, OBSID, LAT, LON, round(x,3) as x, round(y,3) as y from placed where {IN_BOX}"
)
SQL["flt3_in_range"] = _base(
    "select src, rid, DIP, DIP is not null and DIP>=10 and DIP<=45 as inside from pl"
)
SQL["flt4_valid_readings"] = _base(
    """select src, rid, coalesce(DIP between 0 and 90, false) as dip_ok,
    coalesce(DIRECTION_OF_DIP between 0 and 360, false) as azimuth_ok, false as text_ok from pl"""
)

_PLANAR_ROWS = f"""select src, orid, rid, REMARKS, DIP, {_turned('DIRECTION_OF_DIP', '8e0')} as DIRECTION_OF_DIP,
    STYPE_TEXT, FOL_TYPE_TEXT, STYPE, H_SENCE, H_SENCE_TEXT, OBSID, OBS_REMARKS, PROJECT,
    round(x,3) as x, round(y,3) as y, 0e0 as z from planars"""
_LINEAR_ROWS = f"""select src, orid, rid, REMARKS, {_turned('DIRECTION', '8e0')} as DIRECTION, PLUNGE,
    STYPE_TEXT, STYPE, OBSID, OBS_REMARKS, PROJECT, round(x,3) as x, round(y,3) as y, 0e0 as z from linears"""
_VALID_PLANAR = "DIP between 0 and 90 and DIRECTION_OF_DIP between 0 and 360"
_VALID_LINEAR = "PLUNGE between 0 and 90 and DIRECTION between 0 and 360"

SQL["flt5_valid_planars"] = _linked(f"select * from ({_PLANAR_ROWS}) where {_VALID_PLANAR}")
SQL["flt5_valid_linears"] = _linked(f"select * from ({_LINEAR_ROWS}) where {_VALID_LINEAR}")
SQL["flt6_rule_filter"] = _base(
    """select src, rid, DIP, DIRECTION_OF_DIP from pl
    where DIP>20 and DIRECTION_OF_DIP>=0 and DIRECTION_OF_DIP<=360"""
)
_KINDS = {
    "planars": "planars",
    "linears": "linears",
    "rock_observations": "rocks",
    "images": "images",
    "samples": "samples",
    "textures": "textures",
}
SQL["flt7_empty_types"] = _linked(
    " union all ".join(
        f"select '{kind}' as kind, count(*)=0 as is_empty from {cte}" for kind, cte in _KINDS.items()
    )
)

# --- coordinates -----------------------------------------------------------

_XY = "select src, orid as rid, round(x,3) as x, round(y,3) as y from placed"
SQL["geo1_export_system"] = f"with {BASE}, {_projected('obs', 'placed')} {_XY}"
SQL["geo1_utm_zone"] = (
    f"with {BASE}, {_projected('obs', 'placed', 298.257223563)} "
    "select src, orid as rid, round(x,2) as x, round(y,2) as y from placed"
)
SQL["geo1_web_mercator"] = _base(
    """select src, orid as rid, round(6378137e0*radians(LON),3) as x,
    round(6378137e0*ln(tan(pi()/4+radians(LAT)/2)),3) as y from obs"""
)


_E = math.sqrt((2 - 1 / 298.257222101) / 298.257222101)
_E_WGS84 = math.sqrt((2 - 1 / 298.257223563) / 298.257223563)


def _t(lat: float, e: float) -> float:
    """The conic's t of a latitude in degrees, from tangents and powers."""
    s = math.sin(math.radians(lat))
    return math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)


def _m(lat: float, e: float) -> float:
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - e * e * s * s)


def _t_sql(lat: str, e: float) -> str:
    s = f"{_num(e)}*sin(radians({lat}))"
    return f"(tan(pi()/4-radians({lat})/2)/pow((1e0-{s})/(1e0+{s}), {_num(e / 2)}))"


def _conic(source: str, name: str) -> str:
    """CTE of EPSG:3034 in x and y."""
    e = _E
    n = (math.log(_m(35, e)) - math.log(_m(65, e))) / (math.log(_t(35, e)) - math.log(_t(65, e)))
    af = 6378137.0 * _m(35, e) / (n * _t(35, e) ** n)
    r0 = af * _t(52, e) ** n
    return f"""
{name}_r as (select *, {_num(af)}*pow({_t_sql('LAT', e)}, {_num(n)}) as r, {_num(n)}*radians(LON-10) as th from {source}),
{name} as (select * exclude (r, th), 4000000e0+r*sin(th) as x, 2800000e0+{_num(r0)}-r*cos(th) as y from {name}_r)"""


def _q_sql(s: str) -> str:
    e = _num(_E)
    return (
        f"({_num(1 - _E**2)}*({s}/(1e0-{_num(_E**2)}*{s}*{s})"
        f"-ln((1e0-{e}*{s})/(1e0+{e}*{s}))/{_num(2 * _E)}))"
    )


def _equal_area(source: str, name: str) -> str:
    """CTE of EPSG:3035 in x and y, by angles."""
    e, s0 = _E, math.sin(math.radians(52))

    def q(s: float) -> float:
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    b0, rq = math.asin(q(s0) / q(1.0)), 6378137.0 * math.sqrt(q(1.0) / 2)
    d = 6378137.0 * _m(52, e) / (rq * math.cos(b0))
    sb, cb = _num(math.sin(b0)), _num(math.cos(b0))
    return f"""
{name}_b as (select *, asin({_q_sql('sin(radians(LAT))')}/{_num(q(1.0))}) as beta, radians(LON-10) as dl from {source}),
{name}_k as (select *, {_num(rq)}*sqrt(2e0/(1e0+{sb}*sin(beta)+{cb}*cos(beta)*cos(dl))) as k from {name}_b),
{name} as (select * exclude (beta, dl, k), 4321000e0+k*{_num(d)}*cos(beta)*sin(dl) as x,
  3210000e0+k/{_num(d)}*({cb}*sin(beta)-{sb}*cos(beta)*cos(dl)) as y from {name}_k)"""


def _polar(source: str, name: str) -> str:
    """CTE of EPSG:3413 in x and y."""
    e = _E_WGS84
    k = 6378137.0 * _m(70, e) / _t(70, e)
    return f"""
{name} as (select *, {_num(k)}*{_t_sql('LAT', e)}*sin(radians(LON+45)) as x,
  -{_num(k)}*{_t_sql('LAT', e)}*cos(radians(LON+45)) as y from {source})"""


def _old_datum(source: str, name: str) -> str:
    """CTEs that put LON and LAT on the old datum: geocentric, seven parameters, and back by iteration."""
    f = 1 / 298.257223563
    e2 = _num(f * (2 - f))
    fi = 1 / 297.0
    e2i = _num(fi * (2 - fi))
    rx, ry, rz = (f"({_num(math.radians(v / 3600))})" for v in (4.801, 0.345, -1.376))
    m = _num(1 + 1.496e-6)
    steps = ""
    for i in range(6):
        nu = f"(6378388e0/sqrt(1e0-{e2i}*pow(sin(f{i}),2)))"
        steps += f"\n{name}_{i + 1} as (select *, atan((hz+{e2i}*{nu}*sin(f{i}))/p) as f{i + 1} from {name}_{i}),"
    return f"""
{name}_n as (select *, 6378137e0/sqrt(1e0-{e2}*pow(sin(radians(LAT)),2)) as nu from {source}),
{name}_g as (select *, (nu*cos(radians(LAT))*cos(radians(LON))+96.062e0)/{m} as gx,
  (nu*cos(radians(LAT))*sin(radians(LON))+82.428e0)/{m} as gy, (nu*(1e0-{e2})*sin(radians(LAT))+121.753e0)/{m} as gz from {name}_n),
{name}_h as (select *, gx+{rz}*gy-{ry}*gz as hx, gy-{rz}*gx+{rx}*gz as hy, gz+{ry}*gx-{rx}*gy as hz from {name}_g),
{name}_0 as (select *, sqrt(hx*hx+hy*hy) as p, atan(hz/((1e0-{e2i})*sqrt(hx*hx+hy*hy))) as f0 from {name}_h),{steps}
{name} as (select src, orid, OBSID, degrees(atan2(hy, hx)) as LON, degrees(f6) as LAT from {name}_6)"""


_XY2 = "select src, orid as rid, round(x,2) as x, round(y,2) as y from placed"
SQL["geo1_lambert_conic"] = f"with {BASE}, {_conic('obs', 'placed')} {_XY2}"
SQL["geo1_equal_area"] = f"with {BASE}, {_equal_area('obs', 'placed')} {_XY2}"
SQL["geo1_polar_stereographic"] = f"with {BASE}, {_polar('obs', 'placed')} {_XY2}"
_ZONE_25 = _projected("obs", "placed", scale=1.0).replace("27e0", "25e0").replace("500000e0", "25500000e0")
_OLD_GRID = (
    _old_datum("obs", "old")
    + ", "
    + _projected("old", "placed", 297.0, 6378388.0, 1.0).replace("500000e0", "3500000e0")
)
SQL["geo1_zone_of_one_degree"] = f"with {BASE}, {_ZONE_25} {_XY2}"
SQL["geo1_shifted_datum"] = f"with {BASE}, {_OLD_GRID} {_XY2}"


def _boxed(ctes: str, name: str, epsg: int, box: tuple[int, int, int, int]) -> str:
    x0, y0, x1, y1 = box
    inner = ctes.replace("placed", name)
    return (
        f"select * from (with {inner} select src, orid as rid, {epsg} as epsg, OBSID from {name} "
        f"where x between {x0} and {x1} and y between {y0} and {y1})"
    )


SQL["flt2_bounds_in_other_systems"] = (
    f"with {BASE} "
    + " union all ".join(
        [
            _boxed(_conic("obs", "placed"), "p1", 3034, (4450000, 3700000, 4700000, 4100000)),
            _boxed(_equal_area("obs", "placed"), "p2", 3035, (4800000, 4150000, 5100000, 4500000)),
            _boxed(_polar("obs", "placed"), "p3", 3413, (2000000, -1200000, 2600000, -500000)),
            _boxed(_ZONE_25, "p4", 3879, (25350000, 6650000, 25600000, 7000000)),
            _boxed(_OLD_GRID, "p5", 2393, (3300000, 6700000, 3500000, 7100000)),
        ]
    )
)


def _unprojected(source: str) -> str:
    """CTEs that add lon and lat to a relation with px, py in EPSG:3067."""
    c = _series(298.257222101)
    dxi = "".join(f"-{_num(b)}*sin({2*j}*xi)*cosh({2*j}*eta)" for j, b in enumerate(c["beta"], 1))
    deta = "".join(f"-{_num(b)}*cos({2*j}*xi)*sinh({2*j}*eta)" for j, b in enumerate(c["beta"], 1))
    dchi = "".join(f"+{_num(d)}*sin({2*j}*chi)" for j, d in enumerate(c["delta"], 1))
    ka = _num(c["ka"])
    return f"""
u1 as (select *, py/{ka} as xi, (px-500000e0)/{ka} as eta from {source}),
u2 as (select *, xi{dxi} as xr, eta{deta} as er from u1),
u3 as (select *, asin(sin(xr)/cosh(er)) as chi from u2),
geographic as (select * exclude (xi, eta, xr, er, chi),
    27e0+degrees(atan2(sinh(er), cos(xr))) as lon, degrees(chi{dchi}) as lat from u3)"""


# Vertices of the layer documents: a line of three and a point.
_VERTICES = """verts as (
  select c_custkey as k, c_name, 'layers/'||cast(c_custkey as varchar)||'.geojson' as dataset,
    v.f as feature_no, v.kind as geometry_type, v.nth as nth,
    200000+c_custkey*37%300000+v.dx+0.5e0 as px, 6700000+c_custkey*53%600000+v.dy+0.25e0 as py
  from customer, (values (0,'LineString',0,0,0),(0,'LineString',1,100,50),(0,'LineString',2,250,75),
    (1,'Point',0,500,500)) as v(f, kind, nth, dx, dy))"""

SQL["geo2_unproject"] = f"""with {_VERTICES}, {_unprojected('verts')}
select dataset, cast(feature_no as bigint) as feature_no, cast(nth as bigint) as nth,
  round(lon,9) as lon, round(lat,9) as lat from geographic"""


def _iterated(t: str, e: float, name: str, source: str) -> str:
    """CTEs that find ``lat`` from the conic's t by repeated substitution."""
    steps = f"{name}_0 as (select *, pi()/2-2*atan({t}) as f0 from {source})"
    for i in range(8):
        s = f"{_num(e)}*sin(f{i})"
        steps += (
            f",\n{name}_{i + 1} as (select * exclude (f{i}), "
            f"pi()/2-2*atan({t}*pow((1e0-{s})/(1e0+{s}), {_num(e / 2)})) as f{i + 1} from {name}_{i})"
        )
    return steps


def _many_systems() -> str:
    e, w = _E, _E_WGS84
    n = (math.log(_m(35, e)) - math.log(_m(65, e))) / (math.log(_t(35, e)) - math.log(_t(65, e)))
    af = 6378137.0 * _m(35, e) / (n * _t(35, e) ** n)
    r0 = _num(af * _t(52, e) ** n)
    k = _num(6378137.0 * _m(70, w) / _t(70, w))

    def q(s: float) -> float:
        return (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    s0 = math.sin(math.radians(52))
    b0, rq = math.asin(q(s0) / q(1.0)), 6378137.0 * math.sqrt(q(1.0) / 2)
    d = 6378137.0 * _m(52, e) / (rq * math.cos(b0))
    sb, cb, dd = _num(math.sin(b0)), _num(math.cos(b0)), _num(d)
    newton = "eq_0 as (select *, asin(qq/2) as f0 from eq_q)"
    for i in range(6):
        s = f"sin(f{i})"
        newton += (
            f",\neq_{i + 1} as (select * exclude (f{i}), f{i}+pow(1e0-{_num(e * e)}*{s}*{s},2)/(2*cos(f{i}))"
            f"*(qq-{_q_sql(s)})/{_num(1 - e * e)} as f{i + 1} from eq_{i})"
        )
    return f"""with given as (
  select c_custkey as key, c_custkey%4 as k,
    case c_custkey%4 when 0 then 4000000 when 1 then 4500000 when 2 then 1200000 else 300000 end + c_custkey*37%200000 + 0.25e0 as px,
    case c_custkey%4 when 0 then 4000000 when 1 then 4500000 when 2 then -2000000 else 6800000 end + c_custkey*53%200000 + 0.5e0 as py
  from customer),
co as (select *, pow(sqrt(pow(px-4000000e0,2)+pow({r0}-(py-2800000e0),2))/{_num(af)}, {_num(1 / n)}) as t from given where k=0),
{_iterated('t', e, 'co', 'co')},
po as (select *, sqrt(px*px+py*py)/{k} as t from given where k=2),
{_iterated('t', w, 'po', 'po')},
eq_r as (select *, sqrt(pow((px-4321000e0)/{dd},2)+pow((py-3210000e0)*{dd},2)) as rho from given where k=1),
eq_c as (select *, 2*asin(rho/{_num(2 * rq)}) as c from eq_r),
eq_q as (select *, {_num(q(1.0))}*(cos(c)*{sb}+(py-3210000e0)*{dd}*sin(c)*{cb}/rho) as qq from eq_c),
{newton},
verts as (select * from given where k=3), {_unprojected('verts')}
select key, 3034 as code, round(10e0+degrees(atan2(px-4000000e0, {r0}-(py-2800000e0)))/{_num(n)}, 8) as lon,
  round(degrees(f8), 8) as lat from co_8
union all select key, 3413, round(-45e0+degrees(atan2(px, -py)), 8), round(degrees(f8), 8) from po_8
union all select key, 3035, round(10e0+degrees(atan2((px-4321000e0)*sin(c), {dd}*rho*{cb}*cos(c)-{dd}*{dd}*(py-3210000e0)*{sb}*sin(c))), 8),
  round(degrees(f6), 8) from eq_6
union all select key, 3067, round(lon, 8), round(lat, 8) from geographic"""


SQL["geo2_layers_of_many_systems"] = _many_systems()
SQL["geo3_point_wkb"] = _base(
    """select src, orid as rid, '0101000000' as head, cast(cast(LON as bit) as varchar) as lon_bits,
    cast(cast(LAT as bit) as varchar) as lat_bits from obs"""
)
SQL["geo4_point_in_box"] = _base(
    """select src, orid as rid, LAT, LON,
    LON>=22 and LON<=30 and LAT>=60 and LAT<=65 as inside from obs"""
)
SQL["prj3_coordinates"] = (
    f"with {SELECTED} select src, orid as rid, OBSID, round(x,3) as x, round(y,3) as y, 0e0 as z from sel"
)

# --- projections -----------------------------------------------------------

SQL["prj1_column_subset"] = _base("select src, rid, DIP, STYPE from pl")
SQL["prj2_images_keep_both_remarks"] = _linked(
    "select src, orid, rid, OBSID, PROJECT, REMARKS, OBS_REMARKS from images"
)
SQL["prj2_samples_take_remarks"] = _linked(
    "select src, orid, rid, OBSID, PROJECT, SAMPLEID, OBS_REMARKS as REMARKS from samples"
)
SQL["prj4_popup_columns"] = _linked("select src, orid, rid, FIELD_NAME, ROCK_NAME, ST_2 from rocks")
_VALID_ROWS = {
    "planars": (_PLANAR_ROWS, _VALID_PLANAR),
    "linears": (_LINEAR_ROWS, _VALID_LINEAR),
    **{k: (f"select * from {c}", "true") for k, c in _KINDS.items() if k not in ("planars", "linears")},
}
SQL["idx1_row_index"] = _linked(
    " union all ".join(
        f"""select '{kind}' as kind, src, orid, rid, row_idx from (
        select *, row_number() over (order by src, orid, rid{', rid2' if kind == 'textures' else ''})-1
        as row_idx from ({rows})) where {valid}"""
        for kind, (rows, valid) in _VALID_ROWS.items()
    )
)

# --- links -----------------------------------------------------------------

SQL["jn0_exceptions_remap"] = _base(
    f"""select src, orid as rid, OBSID, case {REMAP}
    when OBSID='OB-8' then null else OBSID end as key from obs"""
)
SQL["jn0_exceptions_table"] = _base(
    """select src, orid as rid, OBSID, case when x.listed is null then OBSID else x.other end as key
    from obs left join (select distinct 'OB-'||o_orderkey as listed,
      case when o_orderkey%3>0 then 'OB-'||(o_orderkey+1) end as other
      from orders where o_orderkey%5=0) x on x.listed=OBSID"""
)
SQL["jn1_tectonic_link"] = _linked("select src, orid, OBSID, GDB_ID, n_ids from tect")
SQL["jn2_planars"] = _linked(
    """select src, orid, rid, OBSID, REMARKS, DIP, DIRECTION_OF_DIP, STYPE_TEXT, FOL_TYPE_TEXT, STYPE,
    H_SENCE, H_SENCE_TEXT from planars"""
)
SQL["jn3_linears"] = _linked(
    "select src, orid, rid, OBSID, REMARKS, DIRECTION, PLUNGE, STYPE_TEXT, STYPE from linears"
)
SQL["jn4_images"] = _linked("select src, orid, rid, OBSID, PICTURE_ID, REMARKS from images")
SQL["jn5_samples"] = _linked("select src, orid, rid, OBSID, SAMPLEID, FIELD_NAME from samples")
SQL["jn6_rocks"] = _linked("select src, orid, rid, OBSID, REMARKS, FIELD_NAME, ROCK_NAME from rocks")
SQL["jn7_rock_textures"] = _linked("select src, orid, rid, OBSID, ROCK_NAME, ST_2 from rocks")
SQL["jn8_textures"] = _linked("select src, orid, rid, rid2, OBSID, ST_1, ST_2 from textures")

# Containment as equality: every stem's distinct substrings of an id's length.
_MATCHED = """
, stems as (select distinct path, regexp_replace(regexp_extract(path,'([^/]*)$',1),'\\.[^.]+$','') as stem from files)
, lens as (select distinct length(PICTURE_ID) as n from im)
, subs as (select distinct path, substr(stem, cast(p.i as bigint), n) as sub from stems, lens,
    unnest(range(1, greatest(length(stem)-n+2, 1))) as p(i))
, matched as (select sub as PICTURE_ID, count(*) as n_files,
    case when count(*)=1 then min(path) end as path from subs group by sub)"""
SQL["jn9_image_files"] = _base(
    f"""{_MATCHED} select src, rid, im.PICTURE_ID, coalesce(n_files, 0) as n_files, path
    from im left join matched on matched.PICTURE_ID=im.PICTURE_ID"""
)
SQL["jn10_recheck_flag"] = _base(
    f"""select src, orid as rid, OBSID, {RECHECK} as recheck
    from obs"""
)
SQL["jn10_recheck_table"] = _base(
    """select src, orid as rid, OBSID,
    coalesce(OBSID in (select 'OB-'||o_orderkey from orders where o_orderkey%7=0), false) as recheck
    from obs"""
)
SQL["jn11_missing_targets"] = _base(
    """select src, rid, PICTURE_ID||'.jpg' as name from im
    where 'imgs/'||PICTURE_ID||'.jpg' not in (select path from files)"""
)
SQL["jn12_layer_pairing"] = """
with d as (select s_suppkey as position, 'layers/'||s_name||'.geojson' as dataset, s_name from supplier),
n as (select c_custkey as position, c_name as name from customer where c_custkey%2=0),
c as (select s_suppkey as position, 'red' as color from supplier where s_acctbal>0)
select coalesce(d.position, n.position, c.position) as position, dataset,
  coalesce(name, s_name) as name, color,
  case when dataset is null then 'no_dataset' else 'ok' end as status
from d full join n on n.position=d.position full join c on c.position=coalesce(d.position, n.position)"""

# --- aggregates ------------------------------------------------------------

SQL["agg1_resolve_tectonic"] = _base(
    """, first_seen as (select src, OBSID, GDB_ID, min(rid) as f from tec group by all)
    select src, OBSID, max_by(GDB_ID, f) as GDB_ID, count(*) as n_ids from first_seen group by all"""
)
SQL["agg2_centre"] = (
    f"with {SELECTED} select round(avg(LAT),6) as lat, round(avg(LON),6) as lon from sel"
)
SQL["agg3_texture_tuples"] = _base(
    """select src, ROP_GID, '('||string_agg(''''||ST_2||'''', ', ' order by rid)
    ||case when count(*)=1 then ',)' else ')' end as ST_2 from tx group by src, ROP_GID"""
)
SQL["agg4_duplicate_ids"] = _base("select OBSID, count(*) as n from obs group by OBSID having count(*)>1")
_FIRST_LINEATION = "min_by({'v': DIRECTION}, rid).v"
SQL["agg5_first_lineation"] = _linked(
    f"select src, orid, {_FIRST_LINEATION} as angle from linears group by src, orid"
)


def _metrics(kind: str, rows: str, rules: list[tuple[str, str]]) -> str:
    parts, before, passed = [], "count(*)", "true"
    for step, (column, test) in enumerate(rules, 1):
        passed = f"{passed} and coalesce({test}, false)"
        after = f"count(*) filter (where {passed})"
        parts.append(
            f"select '{kind}' as kind, cast({step} as bigint) as step, '{column}' as rule, "
            f"{before} as rows_before, {after} as rows_after, {before}-{after} as rows_removed from ({rows})"
        )
        before = after
    parts.append(
        f"select '{kind}' as kind, cast({len(rules) + 1} as bigint) as step, 'total' as rule, "
        f"count(*) as rows_before, {before} as rows_after, count(*)-{before} as rows_removed from ({rows})"
    )
    return " union all ".join(parts)


SQL["agg6_filter_metrics"] = _linked(
    " union all ".join(
        [
            _metrics(
                "planars",
                _PLANAR_ROWS,
                [("DIP", "DIP between 0 and 90"), ("DIRECTION_OF_DIP", "DIRECTION_OF_DIP between 0 and 360")],
            ),
            _metrics(
                "linears",
                _LINEAR_ROWS,
                [("PLUNGE", "PLUNGE between 0 and 90"), ("DIRECTION", "DIRECTION between 0 and 360")],
            ),
            *[
                _metrics(kind, f"select * from {cte}", [])
                for kind, cte in _KINDS.items()
                if kind not in ("planars", "linears")
            ],
        ]
    )
)
SQL["dup1_distinct_rows"] = _base(
    """select src, TM_GID, DIP, STYPE, min(rid) as rid from pl
    group by src, TM_GID, DIP, STYPE, REMARKS, DIRECTION_OF_DIP, STYPE_TEXT, FOL_TYPE_TEXT, H_SENCE, H_SENCE_TEXT"""
)
_FIRST_MARKER = "row_number() over (partition by OBSID order by src, orid)=1"
SQL["dup2_first_marker"] = _base(
    f"select src, orid as rid, OBSID, LAT, LON, PROJECT from obs qualify {_FIRST_MARKER}"
)


def _listed(cte: str, value: str, order: str = "rid") -> str:
    return f"(select src, orid, string_agg({value}, ';' order by {order}) as txt from {cte} group by src, orid)"


def _shown(columns: str) -> str:
    """The named columns as one text."""
    return "||'|'||".join(f"coalesce(cast({c} as varchar), '-')" for c in columns.split())


#: The child columns of each type.
_OWN = {
    "planars": "REMARKS DIP DIRECTION_OF_DIP STYPE_TEXT FOL_TYPE_TEXT STYPE H_SENCE H_SENCE_TEXT",
    "linears": "REMARKS DIRECTION PLUNGE STYPE_TEXT STYPE",
    "rock_observations": "REMARKS FIELD_NAME ROCK_NAME ST_2",
    "images": "PICTURE_ID REMARKS",
    "samples": "SAMPLEID FIELD_NAME",
    "textures": "ST_2 ST_1",
}
_NESTED = {
    kind: _listed(
        "rocks" if kind == "rock_observations" else kind,
        _shown(own),
        *(["rid, rid2"] if kind == "textures" else []),
    )
    for kind, own in _OWN.items()
}
SQL["nst1_nested_observations"] = _linked(
    "select sel.src, sel.orid, sel.OBSID, coalesce(tect.GDB_ID, '') as gdb_id, "
    + ", ".join(f"coalesce(a{i}.txt, '') as {kind}" for i, kind in enumerate(_NESTED))
    + " from sel left join tect on tect.src=sel.src and tect.orid=sel.orid "
    + " ".join(
        f"left join {rows} a{i} on a{i}.src=sel.src and a{i}.orid=sel.orid"
        for i, rows in enumerate(_NESTED.values())
    )
)

# --- set operations --------------------------------------------------------

SQL["set1_union_rows"] = _linked(
    """select src, orid, rid, OBSID, STYPE, DIP, null::double as PLUNGE from planars
    union all select src, orid, rid, OBSID, STYPE, null, PLUNGE from linears"""
)
def _cells(relation: str, table: str, columns: str, rid: str = "rid") -> str:
    """A table's rows with all cells as one text; numbers in thousandths."""
    cells = []
    for column in columns.split():
        number = column.endswith("#")
        name = column.rstrip("#")
        value = f"cast(cast(round({name}*1000) as bigint) as varchar)" if number else f"cast({name} as varchar)"
        cells.append(f"coalesce({value}, 'NULL')")
    return f"select src, {rid} as rid, '{table}' as table_name, {" || '|' || ".join(cells)} as cells from {relation}"


#: Relation, table name and columns (those with # are numbers), and what the row id is called.
_TABLE_CELLS = {
    "obs": ("Observation", "OBSID LAT# LON# OBS_REMARKS PROJECT", "orid"),
    "tec": ("Tectonic_measurement", "OBSID GDB_ID"),
    "pl": (
        "BFDS_Planar_structure",
        "TM_GID REMARKS DIP# DIRECTION_OF_DIP# STYPE_TEXT FOL_TYPE_TEXT STYPE H_SENCE H_SENCE_TEXT",
    ),
    "li": ("BFDS_Linear_structure", "TM_GID REMARKS DIRECTION# PLUNGE# STYPE_TEXT STYPE"),
    "rk": ("Rock_observation_point", "OBSID GDB_ID REMARKS FIELD_NAME ROCK_NAME"),
    "tx": ("BFDS_SaT", "ROP_GID ST_2 ST_1"),
    "sa": ("Sample", "OBSID SAMPLEID FIELD_NAME"),
    "im": ("Outcrop_picture", "OBSID PICTURE_ID REMARKS"),
}


def _both_sides() -> str:
    parts = []
    for relation, (table, columns, *rid) in _TABLE_CELLS.items():
        rows = f"(select * from obs qualify {_FIRST_MARKER})" if relation == "obs" else relation
        own = "* replace ('X'||OBSID as OBSID)" if "OBSID" in columns else "*"
        other = f"(select {own} from {rows} o)"
        parts.append(_cells(rows, table, columns, *rid))
        parts.append(_cells(other, table, columns, *rid).replace("select src,", "select 'other_'||src as src,", 1))
    return " union all ".join(parts)


SQL["set2_merged_models"] = _base(_both_sides())
SQL["set3_project_union"] = (
    "select o_orderpriority as PROJECT from orders union select c_mktsegment from customer"
)
SQL["set4_filtered_union"] = _base(
    f"select src, orid as rid, OBSID, PROJECT, LAT, LON from obs where PROJECT in {PROJECTS}"
)

# --- scalar functions ------------------------------------------------------

SQL["scl1_declination"] = _base(
    f"""select src, rid, {_turned('DIRECTION', '8e0')} as east, {_turned('DIRECTION', '(-8e0)')} as west,
    DIRECTION as beyond, {_turned('DIRECTION', '8e0')} as from_text, null::double as no_number from li"""
)
SQL["scl2_dip_colour"] = _base(
    "select src, rid, case when DIP>60 then 'red' when DIP>30 then 'green' else 'blue' end as color from pl"
)
SQL["scl3_style_colour"] = """
select s_suppkey,
  case when s_suppkey%3=1 then case when s_suppkey%2=0 then 'red' else 'black' end end as color,
  case when s_suppkey%3=0 then '0.5' when s_suppkey%3=1 then '1' end as weight,
  case when s_suppkey%3=0 then case when s_suppkey%2=0 then 'red' else 'blue' end end as "strokeColor",
  case when s_suppkey%3=0 then '0.0' end as "fillOpacity"
from supplier"""
SQL["scl4_paths"] = _base(
    """select path, replace(path,'imgs/','') as base,
    replace(replace(replace(path,'imgs/',''),'.png',''),'.jpg','') as stem, path as short from files"""
)
SQL["scl5_strip_quotes"] = (
    "select page_id, replace(replace(html, chr(34), ''), chr(39), '') as html from pages"
)
SQL["scl6_stylesheet_link"] = """
with styled as (select page_id, case when page_id%2=0
    then '<link rel="stylesheet" href="a.css"/>'||chr(10)||html else html end as html from pages),
lines as (select *, string_split(html, chr(10)) as l from styled),
found as (select *, list_max(list_filter(range(1, len(l)+1), lambda i: contains(l[i], 'stylesheet'))) as k from lines)
select page_id,
  case when not contains(html, 'style') then 'no_style' when k is null then 'no_stylesheet' else 'ok' end as status,
  case when k is not null then array_to_string(
    list_concat(list_concat(l[1:k], ['    <link rel="stylesheet" href="styles.css"/>']), l[k+1:]), chr(10)) end as html
from found"""
SQL["scl7_thumbnail_size"] = _base(
    """select path, width, height,
    cast(trunc(cast(height as double)*(800e0/cast(width as double))) as bigint) as new_height from files"""
)

# --- markers ---------------------------------------------------------------

_FIRST_SELECTED = (
    SELECTED
    + f", msel as (select * from sel qualify {_FIRST_MARKER})"
    + _children("msel")
)


def _td(column: str) -> str:
    return f"'<td>'||coalesce({column}, '')||'</td>'"


def _td_number(column: str) -> str:
    return f"'<td>'||coalesce(cast(cast({column} as bigint) as varchar), '')||'</td>'"


_POPUP_ROWS = {
    ("Planar Structures", "planars"): [
        ("DIP", _td_number),
        ("DIRECTION_OF_DIP", _td_number),
        ("STYPE_TEXT", _td),
        ("FOL_TYPE_TEXT", _td),
        ("STYPE", _td),
        ("H_SENCE", _td),
        ("H_SENCE_TEXT", _td),
    ],
    ("Linear Structures", "linears"): [
        ("DIRECTION", _td_number),
        ("PLUNGE", _td_number),
        ("STYPE_TEXT", _td),
        ("STYPE", _td),
    ],
    ("Rock Observations", "rocks"): [("FIELD_NAME", _td), ("ROCK_NAME", _td), ("ST_2", _td)],
    ("Samples", "samples"): [("SAMPLEID", _td), ("FIELD_NAME", _td)],
    ("Textures", "textures"): [("ST_2", _td), ("ST_1", _td)],
}


def _row_html(cells: list) -> str:
    return "'<tr>'||" + "||".join(make(column) for column, make in cells) + "||'</tr>'"


def _section(label: str, cte: str, cells: list) -> str:
    order = "rid, rid2" if cte == "textures" else "rid"
    head = "".join(f"<th>{column}</th>" for column, _ in cells)
    return (
        f"(select src, orid, '<h4>{label}</h4>'||chr(10)||'<table><tr>{head}</tr>'"
        f"||string_agg({_row_html(cells)}, '' order by {order})||'</table>'||chr(10) as txt "
        f"from {cte} group by src, orid)"
    )


def _popups(with_files: bool) -> str:
    """CTEs up to ``popups``: OBSID, block, popup and the marker columns."""
    link = """'<a href="'||path||'">'"""
    shown = f"""{link}||'<img alt="'||REMARKS||'" height=150 src="'||path||'"/></a>'||chr(10)"""
    linked = f"chr(10)||{link}||PICTURE_ID||': '||REMARKS||'</a>'"
    listing = _MATCHED if with_files else ""
    if with_files:
        rows = """select images.*, coalesce(n_files, 0) as n_files, path, row_number() over
            (partition by src, orid order by rid) as k
            from images left join matched on matched.PICTURE_ID=images.PICTURE_ID"""
        text = f"""case when bool_and(n_files=1) then chr(10)||string_agg(
            case when k<=2 then {shown} else {linked} end, '' order by rid) else chr(10) end"""
    else:
        rows, text = "select * from images", "chr(10)"
    sections = [
        _section(label, cte, cells) for (label, cte), cells in _POPUP_ROWS.items()
    ]
    joins = " ".join(
        f"left join {s} s{i} on s{i}.src=msel.src and s{i}.orid=msel.orid"
        for i, s in enumerate(sections)
    )
    bodies = "||".join(f"coalesce(s{i}.txt, '')" for i in range(len(sections)))
    return f"""with {_FIRST_SELECTED}{listing}
, image_rows as ({rows})
, blocks as (select src, orid, {text} as block from image_rows group by src, orid)
, angles as (select src, orid, {_FIRST_LINEATION} as angle from linears group by src, orid)
, popups as (select msel.src, msel.orid, msel.OBSID, msel.PROJECT, msel.LAT, msel.LON,
    angles.src is not null as has_lines, angle,
    {RECHECK} as recheck,
    coalesce(chr(10)||block, '') as block,
    '<h3>'||msel.OBSID||'</h3>'||chr(10)||{bodies}||'<h4>Observation remarks</h4>'||chr(10)||'<p>'
    ||msel.OBS_REMARKS||'</p>'||chr(10)||coalesce('<h4>Images</h4>'||chr(10)||block, chr(10)) as popup
  from msel {joins}
  left join blocks on blocks.src=msel.src and blocks.orid=msel.orid
  left join angles on angles.src=msel.src and angles.orid=msel.orid)
"""


_ICON = """case when has_lines then 'glyphicon-arrow-up' else 'glyphicon-stop' end as icon,
    case when recheck then 'red' when has_lines then 'blue' else 'lightgray' end as color, angle"""
SQL["mrk1_marker_icons"] = (
    _popups(True) + f"select OBSID, LAT, LON, OBSID as tooltip, {_ICON} from popups"
)
SQL["mrk2_popup_tables"] = _linked(
    " union all ".join(
        f"select '{kind}' as kind, src, orid, rid, {_row_html(cells)} as html from {cte}"
        for (_, cte), cells in _POPUP_ROWS.items()
        for kind, own in _KINDS.items()
        if own == cte
    )
)
SQL["mrk3_popups"] = _popups(False) + "select OBSID, popup from popups"
SQL["mrk4_image_blocks"] = _popups(True) + "select OBSID, block from popups"
SQL["mrk5_markers"] = (
    _popups(True)
    + f"select OBSID, PROJECT, LAT, LON, OBSID as tooltip, {_ICON}, popup from popups"
)

# --- validation ------------------------------------------------------------

SQL["val2_contract_violations"] = _base(
    """select 'Observation' as table_name, 'LAT' as column_name, src, orid as rid, 'missing' as reason
    from obs where LAT>=69e0
    union all select 'Observation', 'REMARKS', src, orid, 'missing' from obs where OBS_REMARKS='P'
    union all select 'Outcrop_picture', 'REMARKS', src, rid, 'missing' from im where REMARKS='pic 3'"""
)
SQL["val2_mistyped_cells"] = _base(
    """select 'BFDS_Planar_structure' as table_name, 'DIP' as column_name, src, rid, 'text in number' as reason
    from pl where rid%23=0
    union all select 'Observation', 'LAT', src, orid, 'text in number' from obs where orid%41=0"""
)
SQL["val1_schema_violations"] = _base(
    """, given as (select distinct src, src||'-'||cast(orid//10000 as varchar)||'@1.sqlite' as name from obs)
    select name as src, 'Outcrop_picture' as table_name, 'REMARKS' as column_name, 'no column' as reason
    from given where src='db1'
    union all select name, 'BFDS_SaT', null, 'no table' from given where src='db2'"""
)
SQL["val3_all_points"] = _linked(
    " union all ".join(
        f"select '{kind}' as kind, count(*) as n, cast(0 as bigint) as n_missing from {cte}"
        for kind, cte in _KINDS.items()
    )
)

# --- images ----------------------------------------------------------------

SQL["img1_resize_manifest"] = _base(
    """, listed as (select distinct * from files)
, done as (select distinct replace(path, 'imgs/', '') as name from listed where width%4=0)
, judged as (select replace(path, 'imgs/', '') as name, path, height,
    case when width%10=0 then -1 else width end as width from listed where path like '%.jpg')
select judged.name, path,
  case when done.name is not null then 'exists' when width<=0 then 'invalid' else 'resize' end as status,
  case when done.name is null and width>0 then cast(800 as bigint) end as new_width,
  case when done.name is null and width>0
    then cast(trunc(cast(height as double)*(800e0/width)) as bigint) end as new_height
from judged left join done on done.name=judged.name"""
)


def _thumbnails(name: str, wanted: str) -> str:
    """Thumbnails of 24 columns of the given images."""
    return f"""
with pix as (select vec_id, cast(floor(len(embedding)/2) as bigint) as w,
    list_transform(embedding, lambda e: cast(floor(abs(cast(e as double))*1000) as bigint)%256) as px
  from embeddings where {wanted}),
sized as (select *, cast(trunc(2e0*(24e0/w)) as bigint) as h from pix),
cells as (select vec_id, w, h, px, y, x,
    px[cast(floor((y+0.5e0)*2/h) as bigint)*w + cast(floor((x+0.5e0)*w/24) as bigint) + 1] as v
  from (select *, unnest(range(0, h)) as y from sized) t, unnest(range(0, 24)) as r(x))
select {name}, cast(24 as integer) as width, cast(sized.h as integer) as height,
  coalesce((select string_agg(printf('%02X', v), '' order by y, x) from cells where cells.vec_id=sized.vec_id), '') as pixels
from sized"""


SQL["img2_resample"] = _thumbnails("'imgs/'||cast(sized.vec_id as varchar)||'.png' as path", "true")
SQL["pip5_thumbnails"] = _thumbnails(
    "'v'||cast(sized.vec_id as varchar)||'.png' as name", "vec_id%10<>3 and vec_id%5<>0"
)
# An uncompressed file has 68 bytes besides its lines, each of them a byte longer than its pixels.
SQL["src5_image_listing"] = """
select 'v'||cast(vec_id as varchar)||'.png' as name,
  cast(case when vec_id%10=3 then 8 else 68+2*(len(embedding)//2+1) end as bigint) as length from embeddings"""
SQL["src6_decoded_images"] = """
select 'v'||cast(vec_id as varchar)||'.png' as name,
  cast(case when vec_id%10=3 then -1 else len(embedding)//2 end as integer) as width,
  cast(case when vec_id%10=3 then -1 else 2 end as integer) as height,
  cast(case when vec_id%10=3 then -1 else 1 end as integer) as channels,
  case when vec_id%10=3 then '' else list_reduce(list_transform(embedding[:2*(len(embedding)//2)],
    lambda e: printf('%02X', cast(floor(abs(cast(e as double))*1000) as bigint)%256)), lambda a, b: a||b) end as pixels
from embeddings"""

# --- layers and sources ----------------------------------------------------

SQL["src1_parsed_databases"] = _base(
    "select src, orid as rid, OBSID, LAT, LON, OBS_REMARKS as REMARKS, PROJECT from obs"
)
SQL["src1_sqlite_scan"] = SQL["src1_parsed_databases"]
SQL["src1_filtered_scan"] = _base(
    "select src, orid as rid, OBSID, LAT, LON, OBS_REMARKS as REMARKS, PROJECT from obs "
    "where PROJECT='2-HIGH' and orid>100 and LAT<66"
)


SQL["src2_eight_tables"] = _base(
    " union all ".join(_cells(relation, *rest) for relation, rest in _TABLE_CELLS.items())
)
SQL["src3_databases_of_folder"] = _base(
    """select src||'-'||cast(orid//10000 as varchar)||'@1.sqlite' as src, count(*) as n,
    count(distinct OBSID) as n_ids from obs group by all"""
)
SQL["src4_geojson_features"] = f"""with {_VERTICES}
select dataset, cast(feature_no as bigint) as feature_no, 3067 as epsg, geometry_type,
  cast(nth as bigint) as nth, cast(px as double) as x, cast(py as double) as y,
  case when feature_no=0 then c_name end as label
from verts"""
# One feature per customer: a point or a line of two vertices.
_LINE_VERTICES = """line_verts as (
  select c_custkey as k, nth, case when c_custkey%2=0 then 'Point' else 'LineString' end as geometry_type,
    200000+c_custkey*37%300000 + case when c_custkey%2=0 then 0.5e0 when nth=1 then 0.25e0 else 0e0 end as px,
    6700000+c_custkey*53%600000 + case when c_custkey%2=1 and nth=1 then 0.75e0 else 0e0 end as py
  from customer, (values (0),(1)) as v(nth) where nth=0 or c_custkey%2=1)"""
SQL["src4_feature_lines"] = f"""with {_LINE_VERTICES}
select k as key, 3067 as epsg, geometry_type, cast(nth as bigint) as nth, px as x, py as y from line_verts"""
SQL["pip4_webmap_layers"] = f"""with {_LINE_VERTICES}, {_unprojected('line_verts')}
select case k%3 when 0 then 'First' when 1 then 'Second' else 'part=2' end as name,
  case k%3 when 1 then '1' when 2 then '7' end as weight,
  case when k%3=0 then cast(k as varchar) end as popup, k as key, cast(nth as bigint) as nth,
  round(lon,9) as lon, round(lat,9) as lat
from geographic"""
SQL["src7_rule_rows"] = """
select 'team'||cast(c_custkey as varchar)||'.ini' as file, r.line as line, r.section as section,
  case r.line when 3 then 'site/'||cast(c_custkey as varchar) when 8 then 'site/'||cast(c_custkey%7 as varchar)
    when 13 then '"'||c_mktsegment||'''s' else r.key end as key,
  case r.line when 10 then cast(c_custkey%20 as varchar)||'.5'
    when 16 then case when c_custkey%5=0 then 'west' else cast(c_custkey*10 as varchar) end else r.value end as value
from customer, (values (2,'exceptions',null,null),(3,'exceptions',null,'site/1'),(4,'exceptions','site/x',null),
  (6,'recheck',null,null),(8,'recheck',null,null),(9,'declination',null,null),
  (10,'declination','declination_value',null),(12,'projects',null,null),(13,'projects',null,null),
  (14,'bounds',null,null),(15,'bounds','epsg','3067'),(16,'bounds','xmin',null),(17,'bounds','xmax','900000'),
  (18,'bounds','ymin','6600000'),(19,'bounds','ymax','7800000')) as r(line, section, key, value)"""
SQL["src7_rule_scalars"] = """
select 'team'||cast(c_custkey as varchar)||'.ini' as file, true as has_declination,
  c_custkey%20+0.5e0 as declination, case when c_custkey%5<>0 then 3067 end as bounds_epsg,
  case when c_custkey%5<>0 then cast(c_custkey*10 as double) end as xmin,
  case when c_custkey%5<>0 then 6600000e0 end as ymin,
  case when c_custkey%5<>0 then 900000e0 end as xmax,
  case when c_custkey%5<>0 then 7800000e0 end as ymax
from customer"""
SQL["geo5_layer_features"] = f"""with {_VERTICES}, {_unprojected('verts')}
select cast(k as integer) as position, cast(k as varchar) as name, cast(feature_no as bigint) as feature_no,
  case when k%2=0 and feature_no=0 then c_name end as popup, geometry_type,
  case when k%3=0 then 'green' else 'black' end as color, '1' as weight,
  cast(nth as bigint) as nth, round(lon,9) as lon, round(lat,9) as lat
from geographic"""

# --- whole runs ------------------------------------------------------------

SQL["pip1_selected_observations"] = (
    f"with {SELECTED} select src, orid as rid, OBSID, LAT, LON, OBS_REMARKS as REMARKS, PROJECT from sel"
)
SQL["pip2_planars"] = _linked(_PLANAR_ROWS)
SQL["pip2_linears"] = _linked(_LINEAR_ROWS)
_PLACE = "OBSID, PROJECT, round(x,3) as x, round(y,3) as y, 0e0 as z"
SQL["pip2_rock_observations"] = _linked(
    f"select src, orid, rid, REMARKS, FIELD_NAME, ROCK_NAME, ST_2, OBS_REMARKS, {_PLACE} from rocks"
)
SQL["pip2_images"] = _linked(
    f"select src, orid, rid, PICTURE_ID, REMARKS, OBS_REMARKS, {_PLACE} from images"
)
SQL["pip2_samples"] = _linked(
    f"select src, orid, rid, SAMPLEID, FIELD_NAME, OBS_REMARKS as REMARKS, {_PLACE} from samples"
)
SQL["pip2_textures"] = _linked(
    f"select src, orid, rid, rid2, ST_2, ST_1, OBS_REMARKS as REMARKS, {_PLACE} from textures"
)
SQL["snk1_csv_linears"] = _linked(
    f"""select * exclude (src, orid, rid) from (
    select *, row_number() over (order by src, orid, rid)-1 as row_idx from ({_LINEAR_ROWS}))
    where {_VALID_LINEAR}"""
)
SQL["snk2_parquet_samples"] = _linked(
    """select SAMPLEID, FIELD_NAME, OBS_REMARKS as REMARKS, PROJECT, OBSID, round(x,3) as x, round(y,3) as y,
    3067 as epsg, 21 as n_bytes, '0101000000' as head, substr(cast(cast(x as bit) as varchar), 1, 40) as x_bits,
    substr(cast(cast(y as bit) as varchar), 1, 40) as y_bits from samples"""
)
SQL["snk2_geojson_images"] = _linked(
    "select OBSID, PICTURE_ID, REMARKS, OBS_REMARKS, PROJECT, 'urn:ogc:def:crs:EPSG::3067' as crs, "
    "'Point' as shape, round(x,3) as x, round(y,3) as y from images"
)
SQL["snk3_written_types"] = _linked(
    " union all ".join(
        f"select '{kind}' as kind, {_shown(_OWN[kind])} as own, OBSID, OBS_REMARKS as remarks, PROJECT, "
        f"round(x,3) as x, round(y,3) as y, 0e0 as z, 3067 as epsg from ({rows}) where {valid}"
        for kind, (rows, valid) in _VALID_ROWS.items()
    )
)
SQL["snk4_marker_lines"] = (
    _popups(True)
    + f"select PROJECT, OBSID as tooltip, icon, color, angle, popup, LON as lon, LAT as lat "
    f"from (select * exclude (angle), {_ICON} from popups)"
)
SQL["pip6_newest_snapshots"] = """
with landed as (select o_orderkey, 'team'||cast(o_custkey%40 as varchar) as src,
  strftime(o_orderdate, '%Y-%m') as month,
  cast(year(o_orderdate) as varchar)||'-'||cast(month(o_orderdate) as varchar) as snapshot from orders)
select src, o_orderkey, snapshot from landed l
where month=(select max(month) from landed k where k.src=l.src)"""
SQL["dup2_skipped_observations"] = _base(
    """select src, orid, OBSID, n from (select *, count(*) over (partition by OBSID) as n,
    row_number() over (partition by OBSID order by src, orid) as k from obs) where k > 1"""
)
SQL["agg1_ambiguous_observations"] = _linked(
    "select src, orid, OBSID, GDB_ID, n_ids from tect where n_ids > 1"
)
SQL["flt2_antimeridian_box"] = (
    f"with {BASE}, moved as (select * replace (case when LON<26 then LON-200 else LON+148 end as LON) from obs), "
    + _projected("moved", "placed", 298.257223563).replace("27e0", "(-177e0)")
    + """ select src, orid as rid, OBSID, LON from placed
    where x between 150000e0 and 450000e0 and y between 6600000e0 and 7800000e0"""
)

# What two landings leave: one source's remarks are marked and some of its planar rows gone.
_LANDED = BASE.replace(
    "o_orderstatus as OBS_REMARKS",
    "o_orderstatus||case when cast(floor(o_orderkey/5) as bigint)%3=1 then '+' else '' end as OBS_REMARKS",
).replace("l_linenumber in (1,2,6))", "l_linenumber in (1,2,6) and not (src='db1' and rid%4=0))")
SQL["pip6_landed_tables"] = f"""with {_LANDED}, landed as (
  select src, orid as rid, orid as okey, 'observation' as kind, OBSID as key, OBS_REMARKS as value from obs
  union all select src, rid, rid//10000000, 'planar', TM_GID, cast(cast(DIP as int) as varchar) from pl)
select src||'-'||cast(okey//10000 as varchar) as src, rid, kind, key, value,
  case src when 'db0' then '9' when 'db1' then '10' else '2024-1' end as snapshot,
  cast(case src when 'db0' then 0 else 1 end as bigint) as batch from landed"""
SQL["pip6_landed_export"] = (
    f"with {LINKED.replace(BASE, _LANDED)} "
    f"select * exclude (src, orid, rid) from ({_PLANAR_ROWS}) where {_VALID_PLANAR}"
)
