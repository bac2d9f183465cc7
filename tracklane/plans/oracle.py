"""SQL with the same results as the queries, written independently: plain windows, as-of joins, recursion.

`PARTS` are named subqueries; `sql(final)` puts the ones a query needs in front of it.
"""

from __future__ import annotations

import re

from tracklane.params import AREAS_TEXT, OUTSIDE_AREAS, Params
from tracklane.plans.catalog import HOUR, PARAMS

P: Params = PARAMS
PARTS: dict[str, str] = {}


def part(name: str, text: str) -> None:
    PARTS[name] = text.strip()


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


def sql(final: str) -> str:
    """`final` with the parts it needs, directly or through other parts."""
    names = list(PARTS)
    words = {n: set(re.findall(r"\w+", PARTS[n])) for n in names}
    need, todo = set(), set(re.findall(r"\w+", final)) & set(names)
    while todo:
        n = todo.pop()
        need.add(n)
        todo |= (words[n] & set(names)) - need
    head = ",\n".join(
        f"{n} as ({PARTS[n]})" if n.endswith("_rec") else f"{n} as materialized ({PARTS[n]})" for n in names if n in need
    )
    return f"with recursive {head}\n{final.strip()}" if need else final.strip()


# --- events and elements -------------------------------------------------------------------------
part("ev", """select user_id, event_type, epoch_us(ts) // 1000 as generation_ts, event_id as seq, value, cast(props->>'k' as bigint) as k
from events""")
part("el", """select event_type as stream_name, 'u' || user_id as match_id, generation_ts, seq, seq % 4 = 0 as atomic,
case seq % 4 when 1 then 'START' when 2 then 'ACTIVE' when 3 then 'END' end as phase, event_type, value, k, user_id,
case when k % 3 = 0 then 0 else 1 end as n_groups, case when k % 3 <> 0 then 'g' || (k % 5) end as first_group from ev""")

# --- trace ---------------------------------------------------------------------------------------
part("tr_e", "select event_id, event_id//23 as g, cast(event_id%23 as int) as slot, cast(props->>'k' as int) as k from events")
part("tr_t", "select *, g//144 as m, cast(g%144 as int) as t, cast((g%144)//16 as int) as q, cast(g%16 as int) as p from tr_e")
part("tr_pl", """select m, t.t, i.i as slot,
case when i.i<=11 then -1 else 1 end * (8 + 10*(((i.i-1)%11)//4)) + 0.25*(1+i.i%4)*(abs((t.t+5*i.i)%40-20)-10) as x,
-24.0 + 16*(((i.i-1)%11)%4) + 0.25*(abs((t.t+3*i.i)%24-12)-6) as y
from (select distinct m, t from tr_t) t, range(1,23) i(i)""")
part("tr_pl2", """select m, t, slot, case when t<16 and slot=1+m%22 then 0.5 else x end x,
case when t<16 and slot=1+m%22 then 0.0 else y end y from tr_pl""")
part("tr_b", "select distinct m, t, q, p, 1+(q*7+m)%22 as c, 1+((q+1)*7+m)%22 as n from tr_t")
part("tr_mk", """select b.m, b.t, case when b.c<=11 then b.c+11 else b.c-11 end as slot, p.x+1.5 as x, p.y+0.5 as y
from tr_b b join tr_pl2 p on p.m=b.m and p.t=b.t and p.slot=b.c where b.q%4=1 and b.p between 2 and 6""")
part("tr_ball", """select b.m, b.t,
case when p<8 then case when q=0 then 0.0 else c.x+0.5 end
else (case when q=0 then 0.0 else c.x+0.5 end) + ((case when q%5=3 then (case when q%2=0 then 54.5 else -54.5 end) else n.x+0.5 end)-(case when q=0 then 0.0 else c.x+0.5 end))*(p-7)/8.0 end x,
case when p<8 then c.y else c.y + ((case when q%5=3 then ((b.m+q)%3)*3.0 else n.y end)-c.y)*(p-7)/8.0 end y,
case when p<8 then 0.0 when q%5=3 then case when q%4<2 then 1.0 else 3.0 end else 0.25*least(p-7,15-p) end z
from tr_b b join tr_pl2 c on c.m=b.m and c.t=b.t and c.slot=b.c join tr_pl2 n on n.m=b.m and n.t=b.t and n.slot=b.n""")
part("raw", """select 'm'||t.m as match_id, cast(t.t*200 as bigint) as generation_ts, event_id as seq,
case when t.slot=0 then 'BALL' when t.slot<=11 then 'A'||t.slot else 'B'||(t.slot-11) end as object_id,
case when t.slot=0 then 'BALL' when t.slot<=11 then 'A' else 'B' end as team_id,
cast(coalesce(mk.x,p.x,bl.x) as double) x,
cast(coalesce(mk.y,p.y,bl.y) + case when t.slot>0 and t.slot%5=0 then 0.25*(k%3-1) else 0 end as double) y,
cast(case when t.slot=0 then bl.z else 0.0 end as double) z
from tr_t t left join tr_pl2 p on p.m=t.m and p.t=t.t and p.slot=t.slot
left join tr_mk mk on mk.m=t.m and mk.t=t.t and mk.slot=t.slot
left join tr_ball bl on t.slot=0 and bl.m=t.m and bl.t=t.t""")

# --- states and areas ----------------------------------------------------------------------------
part("st", """select match_id, generation_ts, seq, object_id, team_id, x, y, z, ux*1000 as vx, uy*1000 as vy, uz*1000 as vz,
sqrt(ux*ux+uy*uy+uz*uz)*1000 as vabs from (select *,
coalesce((x-lag(x) over w)/(generation_ts-lag(generation_ts) over w), 0) ux,
coalesce((y-lag(y) over w)/(generation_ts-lag(generation_ts) over w), 0) uy,
coalesce((z-lag(z) over w)/(generation_ts-lag(generation_ts) over w), 0) uz
from raw window w as (partition by match_id, object_id order by generation_ts, seq))""")
_AREAS = [
    (n, *[float(v) for v in box.split("@")]) for n, box in (a.strip("{}").split(":") for a in AREAS_TEXT.split(","))
]
part("area", f"select * from (values {_values(_AREAS)}) v(area_id, min_x, max_x, min_y, max_y)")
part("ros", f"select * from (values {_values(P.roster)}) v(object_id, team_id)")
part("items", f"select * from (values {_values([(i,) for i in P.items])}) v(item)")
part("ae", """select match_id, generation_ts, seq, object_id, team_id, x, y, z, inside as in_area, area_id from (
select *, lag(inside, 1, false) over (partition by match_id, object_id, area_id order by generation_ts, seq) was from (
select s.*, a.area_id, x between min_x and max_x and y between min_y and max_y as inside from st s cross join area a))
where inside <> was""")
part("bl", "select * from st where object_id = 'BALL'")
part("pr", "select * from st where object_id <> 'BALL'")

# --- ball rows with all players ------------------------------------------------------------------
part("snap0", """select b.match_id, b.generation_ts, b.seq, b.x bx, b.y bly, b.z bz, p.object_id, p.team_id, p.x, p.y, p.z,
sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)+(p.z-b.z)*(p.z-b.z)) d3, sqrt((p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y)) d2
from (select b.*, r.object_id oid from bl b cross join ros r) b
asof join st p on b.match_id=p.match_id and b.oid=p.object_id and b.seq>=p.seq""")
part("sn", "select * from snap0 where (match_id, seq) in (select (match_id, seq) from snap0 group by match_id, seq having count(*) = 22)")

# --- kickoffs ------------------------------------------------------------------------------------


def debounced(source: str, key: str, gap: int) -> str:
    return f"""select {key}, unnest(list_reduce(list([{{'t': generation_ts, 's': seq}}] order by generation_ts, seq),
lambda a, x: case when x[1].t - a[len(a)].t > {gap} then list_concat(a, x) else a end), recursive := false) e from {source} group by {key}"""


part("ko_c", f"""select * from (select match_id, generation_ts, seq, any_value(bx) bx, any_value(bly) bly, any_value(bz) bz,
count(distinct team_id) filter (where c) nc, count(distinct team_id) filter (where not c and x < -{P.kickoff_midline_dist}) nl,
count(distinct team_id) filter (where not c and x > {P.kickoff_midline_dist}) nr,
min(team_id) filter (where not c and x < -{P.kickoff_midline_dist}) lt,
min({{'d': d3, 'o': object_id, 't': team_id}}) filter (where c) k
from (select *, sqrt(x*x+y*y+z*z) < {P.kickoff_player_dist} c from sn
where sqrt(bx*bx+bly*bly+bz*bz) <= {P.kickoff_ball_dist}) group by match_id, generation_ts, seq)
where nc = 1 and nl = 1 and nr <= 1""")
part("ko_d", debounced("ko_c", "match_id", P.kickoff_gap_ms))
part("ko", """select c.match_id, generation_ts, seq, k.o player_id, k.t team_id, bx ball_x, bly ball_y, bz ball_z,
case when lt = k.t then k.t when k.t = 'A' then 'B' else 'A' end left_team,
case when lt = k.t then case when k.t = 'A' then 'B' else 'A' end else k.t end right_team
from ko_c c join ko_d d on c.match_id = d.match_id and c.seq = d.e.s""")

# --- possession ----------------------------------------------------------------------------------
part("bh", """select *, row_number() over w rn, x between -52.5 and 52.5 and y between -34 and 34 inf, lag(vabs) over w v1,
lag(x,2) over w - lag(x) over w ax, lag(y,2) over w - lag(y) over w ay, lag(z,2) over w - lag(z) over w az,
lag(x) over w - x bx, lag(y) over w - y bly, lag(z) over w - z bz
from bl window w as (partition by match_id order by generation_ts, seq)""")
part("hit", f"""select *, case when vabs < {P.hit_max_speed} and abs(v1-vabs) > {P.hit_speed_diff} then 'velocity'
when nn > 0 and acos(greatest(-1.0, least(1.0, (ax*bx+ay*bly+az*bz)/nn))) > {P.hit_angle} then 'direction' end as hit_kind
from (select *, sqrt(ax*ax+ay*ay+az*az)*sqrt(bx*bx+bly*bly+bz*bz) nn from bh)""")
part("near", "select *, row_number() over (partition by match_id, seq order by d2, object_id) r from sn")
part("mark", f"""select h.*, n.object_id is not null and (not inf or rn >= 2) as ready,
case when n.object_id is not null and not inf then 'nobody'
when rn >= 2 and inf and hit_kind is not null and n.d2 <= {P.possession_dist} then n.object_id end marker
from hit h left join near n on n.match_id=h.match_id and n.seq=h.seq and n.r=1""")
part("hold", """select *, nullif(last_value(marker ignore nulls) over (partition by match_id order by seq), 'nobody') pid,
nullif(last_value(marker ignore nulls) over (partition by match_id order by seq rows between unbounded preceding and 1 preceding), 'nobody') before
from mark""")
part("poss0", """select h.*, r.team_id pteam, s.x px, s.y py, s.z pz, s.d3 dist, k.left_team from hold h
left join ros r on r.object_id = h.pid left join sn s on s.match_id=h.match_id and s.seq=h.seq and s.object_id=h.pid
asof left join ko k on k.match_id=h.match_id and h.generation_ts >= k.generation_ts""")
part("nearer", """select p.match_id, p.seq, count(o.object_id) filter (where
sqrt((o.x-gx)*(o.x-gx)+o.y*o.y+o.z*o.z) < sqrt((px-gx)*(px-gx)+py*py+pz*pz)) n
from (select *, case when pteam = left_team then 52.5 else -52.5 end gx from poss0 where px is not null) p
join sn o on o.match_id=p.match_id and o.seq=p.seq and o.team_id<>p.pteam group by 1, 2""")
part("poss", "select p.*, n.n num_nearer from poss0 p left join nearer n on n.match_id=p.match_id and n.seq=p.seq")
part("ch", """select match_id, generation_ts, seq, pid player_id, pteam team_id, px player_x, py player_y, pz player_z,
x ball_x, y ball_y, z ball_z, coalesce(num_nearer, 0) num_nearer from poss where marker is not null and pid is distinct from before""")


def phases(name: str, source: str, key: str, order: str) -> None:
    """Rules of a non-atomic event, one row after the other; `source` has the identity in column ident."""
    part(f"{name}_rows", f"select *, row_number() over (partition by {key} order by {order}) as step from ({source})")
    part(f"{name}_rec", f"""select {key}, step, case when ident is not null then 'START' end phase, ident who, ident cur,
case when ident is not null then 1 else 0 end no from {name}_rows where step = 1
union all select r.{key}, r.step, case when c.cur is null then case when r.ident is not null then 'START' end when r.ident = c.cur then 'ACTIVE' else 'END' end,
case when c.cur is null then r.ident else c.cur end,
case when c.cur is null then r.ident when r.ident = c.cur then c.cur end,
c.no + case when c.cur is null and r.ident is not null then 1 else 0 end
from {name}_rec c join {name}_rows r on r.{key} = c.{key} and r.step = c.step + 1""")
    part(name, f"""select r.*, c.who, c.phase, cast(c.no as bigint) event_no from {name}_rows r join {name}_rec c
on r.{key} = c.{key} and r.step = c.step where c.phase is not null""")


phases("duel", f"""select p.match_id, p.generation_ts, p.seq, case when inf and a.team_id <> b.team_id and pid in (a.object_id, b.object_id)
then pid || '|' || case when pid = a.object_id then b.object_id else a.object_id end end ident from poss p
left join near a on a.match_id=p.match_id and a.seq=p.seq and a.r=1 and a.d2 <= {P.duel_dist}
left join near b on b.match_id=p.match_id and b.seq=p.seq and b.r=2 and b.d2 <= {P.duel_dist} where p.ready""", "match_id", "seq")


def ticks(source: str, key: str, period: int, threshold: int) -> str:
    return f"""select g.{key}, g.b * {period} as tick_ts, s.generation_ts as max_generation_ts from (
select {key}, unnest(generate_series(lo, hi)) b from (select {key}, cast(ceil(min(generation_ts) / {period}) as bigint) lo,
cast(ceil(max(generation_ts) / {period}) as bigint) hi from {source} group by {key})) g
asof join (select distinct {key}, generation_ts from {source}) s on s.{key} = g.{key} and g.b * {period} >= s.generation_ts
where g.b * {period} - s.generation_ts <= {threshold}"""


# --- pressing ------------------------------------------------------------------------------------
part("ptick", ticks("st", "match_id", P.pressing_tick_ms, P.active_threshold_ms))
part("all23", "select object_id from ros union all select 'BALL'")


part("ptick_o", """select t.match_id, t.tick_ts as id, p.* exclude (match_id) from (select t.*, a.object_id oid from ptick t cross join all23 a) t
asof join st p on p.match_id=t.match_id and p.object_id=t.oid and t.tick_ts >= p.generation_ts""")
part("pball_o", """select t.match_id, t.seq as id, p.* exclude (match_id) from (select t.*, a.object_id oid from bl t cross join all23 a) t
asof join st p on p.match_id=t.match_id and p.object_id=t.oid and t.seq >= p.seq""")


def pressed(objects: str) -> str:
    return f"""select w.match_id, w.id, w.player_id, coalesce(sum(case when o.d > 0 then greatest(0.0, (o.vp + o.vb)/o.d) end), 0.0) pressing_index
from (select f.match_id, f.id, c.player_id, c.team_id from (select match_id, id, max(generation_ts) generation_ts from {objects}
group by match_id, id having count(*) = 23) f asof left join ch c on c.match_id=f.match_id and f.generation_ts >= c.generation_ts) w
left join (select match_id, id, team_id, d, (vx*(bx-x)+vy*(bly-y)+vz*(bz-z))/d vp, (bvx*(x-bx)+bvy*(y-bly)+bvz*(z-bz))/d vb
from (select o.*, b.x bx, b.y bly, b.z bz, b.vx bvx, b.vy bvy, b.vz bvz,
sqrt((o.x-b.x)*(o.x-b.x)+(o.y-b.y)*(o.y-b.y)+(o.z-b.z)*(o.z-b.z)) d from {objects} o
join {objects} b on b.match_id=o.match_id and b.id=o.id and b.object_id='BALL' where o.object_id<>'BALL')) o
on o.match_id=w.match_id and o.id=w.id and o.team_id <> w.team_id group by 1, 2, 3"""


part("pstate", f"""select p.match_id, p.id tick_ts, t.max_generation_ts generation_ts, p.player_id, p.pressing_index
from ({pressed('ptick_o')}) p join ptick t on t.match_id=p.match_id and t.tick_ts=p.id""")
part("pindex", pressed("pball_o"))
phases("press", f"select *, case when pressing_index >= {P.pressing_min} then player_id end ident from pstate", "match_id", "tick_ts")

# --- kicks and passes ----------------------------------------------------------------------------
part("kk0", f"""select * from (select *, last_value(far ignore nulls) over (partition by match_id order by seq rows between unbounded preceding and 1 preceding) was
from (select *, case when dist > {P.kick_dist} then 1 when dist < {P.ball_back_dist} then 0 end far from poss where pid is not null and dist is not null))
where far = 1 and coalesce(was, 0) = 0""")
part("kk", """select k.match_id, k.generation_ts, k.seq, k.pid player_id, k.pteam team_id, px player_x, py player_y, pz player_z,
x ball_x, y ball_y, z ball_z, num_nearer,
case when inf and x <= -17.5 then 'left' when inf and x <= 17.5 then 'center' when inf then 'right' else 'outside' end as zone,
coalesce(d.phase <> 'END', false) or coalesce(p.phase <> 'END', false) as attacked from kk0 k
asof left join duel d on d.match_id=k.match_id and k.generation_ts >= d.generation_ts
asof left join press p on p.match_id=k.match_id and k.generation_ts >= p.generation_ts""")
_OUT = ", ".join(f"'{a}'" for a in OUTSIDE_AREAS)
part("second", f"""select c.match_id, c.generation_ts, c.seq, 1 kind, '' area_id, player_id receiver, team_id receiver_team,
player_x end_x, player_y end_y, player_z end_z, num_nearer receiver_nearer,
case when ball_x <= -17.5 then 'left' when ball_x <= 17.5 then 'center' else 'right' end end_zone from ch c where player_id is not null
union all select match_id, generation_ts, seq, 0, area_id, null, null, x, y, z, null, null from ae
where object_id = 'BALL' and in_area and area_id in ({_OUT})""")
part("pm", f"""select * from (select *, row_number() over (partition by match_id, kick_ts order by generation_ts, seq, kind, area_id) r from (
select s.*, k.generation_ts kick_ts, k.player_id kicker, k.team_id kicker_team, k.player_x kick_x, k.player_y kick_y, k.player_z kick_z,
k.num_nearer kicker_nearer, k.attacked, k.zone kick_zone, o.left_team from second s
asof join kk k on k.match_id=s.match_id and s.generation_ts > k.generation_ts
asof join ko o on o.match_id=s.match_id and s.generation_ts >= o.generation_ts)
where generation_ts - kick_ts <= {P.pass_max_ms}) where r = 1""")
part("pg", """select *, sqrt(dx*dx+dy*dy+dz*dz) length, sqrt(dx*dx+dy*dy+dz*dz)/(generation_ts-kick_ts)*1000 velocity,
case when (lft and dy < 0) or (not lft and dy > 0) then 2*pi() - a else a end angle from (select *,
acos(greatest(-1.0, least(1.0, (case when lft then dx else -dx end)/sqrt(dx*dx+dy*dy+dz*dz)))) a from (select *, end_x-kick_x dx, end_y-kick_y dy, end_z-kick_z dz,
kicker_team = left_team lft, attacked and kick_zone = (case when kicker_team = left_team then 'left' else 'right' end) pressed from pm))""")
_T = P.sideways_angle
part("pa", f"""select *, case when outcome = 'successful_pass' then kicker_nearer - receiver_nearer end packing from (select *,
case when angle < {_T} or angle > 2*pi()-{_T} then 'FORWARD' when angle <= pi()-{_T} then 'RIGHT' when angle < pi()+{_T} then 'BACKWARD' else 'LEFT' end direction,
case when kind = 1 and kicker_team = receiver_team then 'successful_pass'
when kind = 1 and pressed and (end_zone = 'center' or end_zone = case when lft then 'right' else 'left' end) then 'clearance'
when kind = 1 then 'interception'
when area_id in ('leftGoal', 'rightGoal') and end_z < {P.goal_height} then 'goal' when pressed then 'clearance'
when area_id in ('leftGoal', 'slightlyAboveLeftGoal', 'slightlyBelowLeftGoal') then case when lft then 'misplaced_pass' else 'shot_off_target' end
when area_id in ('rightGoal', 'slightlyAboveRightGoal', 'slightlyBelowRightGoal') then case when lft then 'shot_off_target' else 'misplaced_pass' end
else 'misplaced_pass' end outcome from pg)""")
part("stops", """select match_id, generation_ts from pa where outcome in ('interception', 'misplaced_pass', 'clearance')
union select match_id, generation_ts from ae where object_id = 'BALL' and area_id = 'field' and not in_area""")
part("sp", f"""select *, sum(brk) over (partition by match_id order by generation_ts, seq) isl from (select p.*,
case when kicker_team = lag(kicker_team) over w and p.generation_ts - lag(p.generation_ts) over w <= {P.pass_gap_ms}
and lag(receiver) over w = kicker and coalesce(s.generation_ts <= lag(p.generation_ts) over w, true) then 0 else 1 end brk
from (select * from pa where outcome = 'successful_pass') p asof left join stops s on s.match_id=p.match_id and p.generation_ts >= s.generation_ts
window w as (partition by p.match_id order by p.generation_ts, p.seq))""")
part("chain", """select match_id, generation_ts, seq, kicker_team team_id, row_number() over w length, first_value(generation_ts) over w first_ts,
string_agg(kicker || '>' || receiver, ';') over w passes, list(kicker) over w kickers, list(receiver) over w receivers, isl from sp
window w as (partition by match_id, isl order by generation_ts, seq)""")
part("member", """select *, length = 2 and kickers[1] = receivers[2] dbl from (select *,
unnest(list_distinct(list_concat([team_id], list_concat(kickers, receivers)))) item from chain where length >= 2)""")

# --- set plays -----------------------------------------------------------------------------------
_N = P.set_play_history
part("sp_c", f"""select * from (select h.match_id, h.generation_ts, h.seq, h.x, h.y, h.z, n.object_id, n.team_id,
case when static and h.vabs >= {P.set_play_moving} then
case when x0 between -52.5 and -36 and y0 between -20.16 and 20.16 then case when n.team_id = k.left_team then 'goalkick' else 'penalty' end
when x0 between 36 and 52.5 and y0 between -20.16 and 20.16 then case when n.team_id = k.left_team then 'penalty' else 'goalkick' end
when inf and abs(x0) >= 50.5 and abs(y0) >= 32 then 'cornerkick' when inf then 'freekick' end
when inf and h.generation_ts - a.generation_ts < {P.throw_in_ms} then 'throwin' end kind
from (select *, x x0, y y0, max(vabs) over (partition by match_id order by seq rows between {_N - 1} preceding and 1 preceding) <= {P.set_play_static} static from bh) h
join near n on n.match_id=h.match_id and n.seq=h.seq and n.r=1 and n.d2 <= {P.set_play_dist}
asof left join ko k on k.match_id=h.match_id and h.generation_ts >= k.generation_ts
asof left join (select * from ae where object_id='BALL' and area_id='field') a on a.match_id=h.match_id and h.generation_ts >= a.generation_ts
where h.rn >= {_N}) where kind is not null""")
part("sp_d", debounced("sp_c", "match_id", P.set_play_gap_ms))
part("play", """select c.match_id, generation_ts, seq, kind, object_id player_id, team_id, x ball_x, y ball_y, z ball_z
from sp_c c join sp_d d on c.match_id=d.match_id and c.seq=d.e.s""")

# --- offside -------------------------------------------------------------------------------------
part("heldby", """select s.*, c.player_id holder_player, c.team_id holder_team from pr s
asof left join ch c on c.match_id=s.match_id and s.generation_ts >= c.generation_ts""")
part("off0", """select * from (select h.*, holder_player is null nobody, lag(holder_player is null) over (partition by h.match_id order by h.seq) p, k.left_team from heldby h
asof left join ko k on k.match_id=h.match_id and h.generation_ts >= k.generation_ts
where holder_player is null or (holder_player = object_id and left_team is not null)) where not nobody or not coalesce(p, false)""")
part("off1", """select o.match_id, o.seq, o.x, o.team_id, case when o.team_id = o.left_team then 1 else -1 end dir, p.object_id other, p.team_id other_team, p.x ox
from (select o.*, r.object_id oid from off0 o cross join ros r where not nobody) o
asof join st p on p.match_id=o.match_id and p.object_id=o.oid and o.seq >= p.seq""")
part("off2", """select match_id, seq, any_value(dir) dir, greatest(any_value(x*dir), list_distinct(list(ox*dir) filter (where other_team <> team_id)).list_sort('DESC')[2]) line
from off1 group by 1, 2""")
part("off3", """select o.match_id, o.seq, coalesce(string_agg(other, ';' order by other) filter (where other_team = team_id and ox*o.dir > line), '') who
from off1 o join off2 l on l.match_id=o.match_id and l.seq=o.seq group by 1, 2""")

# --- team areas ----------------------------------------------------------------------------------
part("tpt", """select * from (select s.match_id, s.generation_ts, s.seq, s.team_id, p.x, p.y, count(*) over (partition by s.match_id, s.seq) n
from (select s.*, r.object_id oid from pr s join ros r on r.team_id=s.team_id) s
asof join st p on p.match_id=s.match_id and p.object_id=s.oid and s.seq >= p.seq) where n = 11""")
part("mbr", """select match_id, generation_ts, seq, team_id, (max(x)-min(x))*(max(y)-min(y)) mbr_surface from tpt group by all""")
part("hull_p", "select distinct match_id, seq, x, y from tpt")
part("hull", """select match_id, seq, sum(s) hull_surface from (select a.match_id, a.seq, any_value(a.x*b.y-b.x*a.y)/2 s
from hull_p a join hull_p b on a.match_id=b.match_id and a.seq=b.seq and (a.x<>b.x or a.y<>b.y) join hull_p k on k.match_id=a.match_id and k.seq=a.seq
group by a.match_id, a.seq, a.x, a.y, b.x, b.y having bool_and((b.x-a.x)*(k.y-a.y)-(b.y-a.y)*(k.x-a.x) > 0
or ((b.x-a.x)*(k.y-a.y)-(b.y-a.y)*(k.x-a.x) = 0 and (k.x-a.x)*(k.x-b.x)+(k.y-a.y)*(k.y-b.y) <= 0))) group by 1, 2""")


def deadbands(name: str, source: str, key: str, a: str, b: str, epsilon: float) -> None:
    """Both measures keep their own stored value; a row is kept when one of them moved."""
    part(f"{name}_rows", f"select *, row_number() over (partition by {key} order by generation_ts, seq) as step from ({source})")
    keys = [k.strip() for k in key.split(",")]
    on = " and ".join(f"r.{k}=c.{k}" for k in keys)
    part(f"{name}_rec", f"""select {key}, step, {a} ka, {b} kb, true kept from {name}_rows where step = 1
union all select {', '.join('r.' + k for k in keys)}, r.step, case when abs(r.{a}-c.ka) > {epsilon} then r.{a} else c.ka end,
case when abs(r.{b}-c.kb) > {epsilon} then r.{b} else c.kb end, abs(r.{a}-c.ka) > {epsilon} or abs(r.{b}-c.kb) > {epsilon}
from {name}_rec c join {name}_rows r on {on} and r.step = c.step + 1""")
    part(name, f"select r.* from {name}_rows r join {name}_rec c on {on} and r.step = c.step where c.kept")


deadbands("tarea", "select m.*, coalesce(h.hull_surface, 0.0) hull_surface from mbr m left join hull h on h.match_id=m.match_id and h.seq=m.seq",
          "match_id, team_id", "mbr_surface", "hull_surface", P.area_epsilon)
deadbands("evband", "select user_id, generation_ts, seq, value, cast(k as double) as level from ev", "user_id", "value", "level", 30.0)

# --- speed, dribbling, distance ------------------------------------------------------------------
_LEVEL = " + ".join(f"cast(vabs >= {t} as int)" for t in P.speed_levels)
part("slc", f"""select * from (select *, lag(speed_level) over (partition by match_id, object_id order by seq) p from (
select match_id, generation_ts, seq, object_id, team_id, {_LEVEL} as speed_level from pr)) where p is distinct from speed_level""")
part("sls", """select *, sum(ms) over w total from (select match_id, generation_ts, seq, ms, level, unnest([object_id, team_id]) item from (
select *, generation_ts - lag(generation_ts) over w ms, lag(speed_level) over w level from slc window w as (partition by match_id, object_id order by seq)) where ms > 0)
window w as (partition by match_id, item order by seq)""")
part("dr_rows", """select *, row_number() over (partition by match_id order by seq) as step from (select *,
lag(coalesce(holder_player = object_id, false)) over (partition by match_id, object_id order by seq) was from heldby)
where coalesce(holder_player = object_id, false) or was""")
_FAST = f"r.vabs >= {P.dribble_speed}"
part("dr_rec", f"""select match_id, step, cast(null as varchar) who, cast(null as bigint) start_ts, 0.0::double len, 0.0::double lx, 0.0::double ly, 0.0::double lz,
case when holder_player = object_id and vabs >= {P.dribble_speed} then object_id end waiter,
case when holder_player = object_id and vabs >= {P.dribble_speed} then generation_ts end since, cast(null as varchar) phase, cast(null as bigint) dur, 0.0::double out_len
from dr_rows where step = 1
union all select match_id, step,
case act when 'START' then object_id when 'ACTIVE' then who when 'END' then null else who end,
case act when 'START' then ts when 'END' then null else start_ts end,
case act when 'ACTIVE' then len + d when 'KEEP' then len else 0.0 end,
case when act in ('START', 'ACTIVE') then x else lx end, case when act in ('START', 'ACTIVE') then y else ly end, case when act in ('START', 'ACTIVE') then z else lz end,
case act when 'WAIT' then object_id when 'START' then null when 'CLEAR' then null else waiter end,
case act when 'WAIT' then ts when 'START' then null when 'CLEAR' then null else since end,
case when act in ('START', 'ACTIVE', 'END') then act end, case act when 'START' then 0 else ts - start_ts end,
case when act in ('ACTIVE', 'END') then len + d else 0.0 end
from (select c.*, r.object_id, r.x, r.y, r.z, r.generation_ts ts, sqrt((r.x-c.lx)*(r.x-c.lx)+(r.y-c.ly)*(r.y-c.ly)+(r.z-c.lz)*(r.z-c.lz)) d, r.step as new_step,
case when who is not null and who is distinct from r.holder_player then case when r.object_id = who then 'END' else 'KEEP' end
when r.holder_player is distinct from r.object_id then 'KEEP'
when {_FAST} and who is not null then 'ACTIVE' when {_FAST} and waiter is null then 'WAIT'
when {_FAST} and waiter = r.object_id then case when r.generation_ts - since > {P.dribble_ms} then 'START' else 'KEEP' end
when {_FAST} then 'CLEAR' when who is not null then 'END' else 'CLEAR' end act
from dr_rec c join dr_rows r on r.match_id = c.match_id and r.step = c.step + 1)""".replace("union all select match_id, step,", "union all select match_id, new_step,"))
part("dr", """select r.match_id, r.generation_ts, r.seq, r.object_id player_id, r.team_id, c.phase, c.dur duration, c.out_len length,
case when c.phase = 'START' then 0.0 when c.dur > 0 then c.out_len / c.dur * 1000 end velocity,
cast(sum(case when c.phase = 'START' then 1 else 0 end) over (partition by r.match_id order by r.seq) as bigint) event_no
from dr_rec c join dr_rows r on r.match_id=c.match_id and r.step=c.step where c.phase is not null""")
part("dtick", ticks("pr", "match_id", P.distance_tick_ms, P.active_threshold_ms))
part("dmove", """select *, coalesce(sqrt((x-lag(x) over w)*(x-lag(x) over w)+(y-lag(y) over w)*(y-lag(y) over w)+(z-lag(z) over w)*(z-lag(z) over w)), 0.0) d from (
select t.match_id, t.tick_ts, t.max_generation_ts, p.object_id, p.team_id, p.x, p.y, p.z, count(*) over (partition by t.match_id, t.tick_ts) n
from (select t.*, r.object_id oid from dtick t cross join ros r) t
asof join st p on p.match_id=t.match_id and p.object_id=t.oid and t.tick_ts >= p.generation_ts) where n = 22
window w as (partition by match_id, object_id order by tick_ts)""")

# --- heatmaps ------------------------------------------------------------------------------------
part("hc", f"""select match_id, generation_ts, seq, object_id, team_id, cast(floor((x+52.5)/(105.0/{P.grid_x})) as bigint) cell_x,
cast(floor((y+34.0)/(68.0/{P.grid_y})) as bigint) cell_y from pr where x > -52.5 and x < 52.5 and y > -34 and y < 34""")
part("hs", """select match_id, generation_ts//1000 as second, item, cell_x, cell_y, count(*) n from (
select *, unnest([object_id, team_id]) item from hc) group by all""")
part("hspan", """select s.match_id, item, min(second) first_s, any_value(last_s) last_s from hs s
join (select match_id, max(second) last_s from hs group by 1) l on l.match_id=s.match_id group by 1, 2""")
part("hgrid", f"""select match_id, item, i as interval_s, unnest(generate_series(first_s, last_s)) as second from hspan, (select unnest([{', '.join(map(str, P.intervals_s))}]) i)""")
part("hi", f"""select match_id, item, interval_s, cell_x, cell_y, second, cast(sum(n) as bigint) n from (select s.match_id, s.item, i as interval_s, cell_x, cell_y, n,
unnest(generate_series(s.second, case when i = 0 then last_s else least(last_s, s.second + i - 1) end)) as second
from hs s join hspan l on l.match_id=s.match_id and l.item=s.item, (select unnest([{', '.join(map(str, P.intervals_s))}]) i)) group by all""")
part("hrle", f"""select match_id, item, interval_s, second, sum(n) total, max(c) last_c,
string_agg(case when gap > 0 then '0x' || gap || ';' else '' end || n, ';' order by c) t from (
select *, c - coalesce(lag(c) over (partition by match_id, item, interval_s, second order by c), -1) - 1 gap
from (select *, cell_x*{P.grid_y}+cell_y c from hi)) group by 1, 2, 3, 4""")


def _zero(x: str) -> str:
    return f"round({x}, 6) + 0.0 as {x.split('.')[-1]}"


FINALS: dict[str, str] = {
    "read_stream": "select event_type as topic, match_id, generation_ts, seq from el where event_type in ('click', 'view')",
    "write_stream": "select match_id, generation_ts, seq, object_id, area_id, in_area from ae",
    "stream_guard": "select stream_name, match_id, seq from el where k % 10 <> 0",
    "arrival_metadata": "select user_id, generation_ts, generation_ts + k as append_ts, seq as \"offset\" from ev",
    "processing_latency": "select match_id, generation_ts, generation_ts + 5 + seq % 40 as processing_ts, 5 + seq % 40 as latency_ms from bl",
    "union_streams": """select user_id, generation_ts, seq, case when event_type = 'click' then k end as k,
        case when event_type = 'view' then value end as value from ev where event_type in ('click', 'view')""",
    "extract_static": "select match_id, seq, 'v1' as v from el",
    "extract_field": "select match_id, seq, k as a, value as b, atomic as c from el",
    "extract_array_value": "select match_id, seq, event_type as a, k as b from el",
    "extract_array_size": "select match_id, seq, cast(n_groups as bigint) as a, cast(2 as bigint) as b from el",
    "extract_key": "select match_id, seq, match_id as a from el",
    "extract_stream_name": "select match_id, seq, event_type as a from el",
    "extract_none": "select match_id, seq, event_type as b from el",
    "extract_position": "select match_id, seq, value as x, cast(k as double) as y, cast(0 as double) as z from el",
    "extract_phase": "select match_id, seq, case when not atomic then phase end as phase from el",
    "filter_eq": "select stream_name, match_id, seq from el where event_type = 'click'",
    "filter_ne": "select stream_name, match_id, seq from el where event_type <> 'click'",
    "filter_in": "select stream_name, match_id, seq from el where k in (1, 5, 42)",
    "filter_all": "select stream_name, match_id, seq from el where k % 2 = 0 and event_type <> 'view'",
    "filter_any": "select stream_name, match_id, seq from el where event_type = 'error' or n_groups = 0",
    "filter_error_drop": "select stream_name, match_id, seq from el where first_group is not null and first_group <> 'g1'",
    "latest_value": """select user_id, seq, last_value(case when event_type = 'view' then value end ignore nulls)
        over (partition by user_id order by generation_ts, seq) as latest from ev""",
    "latest_value_default": """select user_id, seq, coalesce(last_value(case when event_type = 'view' then k end ignore nulls)
        over (partition by user_id order by generation_ts, seq), 0) as latest from ev""",
    "running_increase": """select user_id, seq, cast(coalesce(sum(case when event_type = 'purchase' then k end)
        over (partition by user_id order by generation_ts, seq), 0) as bigint) as total from ev""",
    "history_n": """select user_id, seq, concat_ws(';', k, lag(k) over w, lag(k, 2) over w) as history from ev
        window w as (partition by user_id order by generation_ts, seq)""",
    "history_latest": """select user_id, seq, h[len(h)] as newest, case when len(h) > 1 then h[len(h) - 1] end as older from (
        select user_id, seq, list(k) filter (where event_type = 'error') over (partition by user_id order by generation_ts, seq) as h from ev)""",
    "store_many": """select match_id, seq, last_value(phase ignore nulls) over w as latest_phase, cast(n_groups as bigint) as latest_size,
        concat_ws(';', k, lag(k) over w) as long_history from el window w as (partition by match_id order by generation_ts, seq)""",
    "composite_inner_key": "select user_id, event_type, seq, lag(k) over (partition by user_id, event_type order by generation_ts, seq) as before from ev",
    "snapshot_asof": f"select match_id, generation_ts, seq, object_id, team_id, {_zero('x')}, {_zero('y')}, {_zero('z')} from sn",
    "asof_join": """select p.user_id, p.generation_ts, p.seq, p.value, c.seq as click_seq, c.value as click_value
        from (select * from ev where event_type = 'purchase') p asof left join (select * from ev where event_type = 'click') c
        on c.user_id = p.user_id and p.seq >= c.seq""",
    "possession_state": "select match_id, generation_ts, seq, object_id, holder_player, holder_team, holder_player is not null as someone from heldby",
    "active_keys": "select user_id, max(generation_ts + k) as last_processing_ts, max(generation_ts) as max_generation_ts from ev group by user_id",
    "active_key_ticks": ticks("ev", "user_id", HOUR, 6 * HOUR),
    "debounce": f"select user_id, e.t as generation_ts, e.s as seq from ({debounced('ev', 'user_id', 6 * HOUR)})",
    "emit_on_change": """select user_id, seq, event_type from (select *, lag(event_type) over (partition by user_id order by generation_ts, seq) p from ev)
        where p is distinct from event_type""",
    "deadband": "select user_id, generation_ts, seq, value, level from evband",
    "phase_events": "select user_id, seq, who as identity, phase, event_no from evphase",
    "initial_statistics": f"""select match_id, generation_ts, statistics, item from (
        select s as statistics, match_id, min(generation_ts) generation_ts from (
            select unnest(['pass_statistics', 'shot_statistics']) s, match_id, generation_ts from (
                select match_id, generation_ts from ch
                union all select match_id, generation_ts from ae where object_id = 'BALL' and area_id in ({_OUT}))
            union all select 'set_play_statistics', match_id, generation_ts from bl
            union all select 'pass_sequence_statistics', match_id, generation_ts from pa where outcome = 'successful_pass'
            union all select unnest(['speed_level_statistics', 'dribbling_statistics']), match_id, generation_ts from pr)
        group by all), items""",
    "item_rollup": """select match_id, seq, item, count(*) over (partition by match_id, item order by seq) as kicks from (
        select match_id, seq, unnest([player_id, team_id]) as item from kk)""",
    "field_object_state": f"""select match_id, generation_ts, seq, object_id, team_id, {', '.join(_zero(c) for c in ('x', 'y', 'z', 'vx', 'vy', 'vz', 'vabs'))} from st""",
    "rename_map": "select match_id, seq, case object_id when 'BALL' then 'ball' when 'A1' then 'keeper' when 'B11' then 'striker' else object_id end as object_id from raw",
    "parse_areas": "select match_id, area_id, cast(min_x as double) min_x, cast(max_x as double) max_x, cast(min_y as double) min_y, cast(max_y as double) max_y from (select distinct match_id from raw), area",
    "parse_roster": "select match_id, object_id, team_id, readings from (select match_id, count(*) readings from raw group by 1), ros",
    "distance": "select match_id, seq, object_id, round(d3, 6) as dist, round(d2, 6) as flat_dist from sn",
    "norm": "select match_id, seq, round(sqrt(x*x+y*y+z*z), 6) as norm from st",
    "angle": """select match_id, seq, case when n > 0 then round(acos(greatest(-1.0, least(1.0, (vx*x+vy*y+vz*z)/n))), 6) end as angle
        from (select *, sqrt(vx*vx+vy*vy+vz*vz)*sqrt(x*x+y*y+z*z) n from st)""",
    "projected_norm": """select match_id, seq, case when n > 0 then round((vx*x+vy*y+vz*z)/n, 6) + 0.0 else 0.0 end as speed
        from (select *, sqrt(x*x+y*y+z*z) n from st)""",
    "nearest_object": """select match_id, seq, case when d2 <= 5 then object_id end as object_id, case when d2 <= 5 then team_id end as team_id,
        case when d2 <= 5 then round(d2, 6) end as dist from near where r = 1""",
    "k_nearest": "select match_id, seq, r - 1 as rank, object_id, round(d2, 6) as dist from near where r <= 3 and d2 <= 20",
    "players_nearer_to_goal": "select match_id, seq, pid as player_id, num_nearer from poss where num_nearer is not null",
    "area_event": f"select match_id, generation_ts, seq, object_id, team_id, {_zero('x')}, {_zero('y')}, {_zero('z')}, in_area, area_id from ae",
    "kickoff_event": "select * from ko",
    "match_time_progress": """select match_id, generation_ts, seq, time_in_s from (select *, max(time_in_s) over (partition by match_id order by seq rows between unbounded preceding and 1 preceding) m
        from (select b.match_id, b.generation_ts, b.seq, (b.generation_ts - o.t) // 1000 as time_in_s from bl b asof join (select match_id, generation_ts,
        min(generation_ts) over (partition by match_id order by generation_ts rows between 99 preceding and current row) t from ko) o
        on o.match_id = b.match_id and b.generation_ts >= o.generation_ts)) where m is null or time_in_s > m""",
    "ball_hit": "select match_id, generation_ts, seq, hit_kind as hit from hit where hit_kind is not null",
    "ball_possession_change": f"""select match_id, generation_ts, seq, player_id, team_id, {', '.join(_zero(f'{a}_{c}') for a in ('player', 'ball') for c in 'xyz')}, num_nearer from ch""",
    "duel_event": "select match_id, generation_ts, seq, split_part(who, '|', 1) as defending, split_part(who, '|', 2) as attacking, phase, event_no from duel",
    "kick_event": f"""select match_id, generation_ts, seq, player_id, team_id, {', '.join(_zero(f'{a}_{c}') for a in ('player', 'ball') for c in 'xyz')}, num_nearer, zone, attacked from kk""",
    "pass_shot_match": "select match_id, generation_ts, seq, kick_ts, kicker, receiver, area_id from pm",
    "pass_classify": "select match_id, kick_ts, outcome from pa",
    "pass_geometry": f"select match_id, kick_ts, {_zero('length')}, {_zero('velocity')}, {_zero('angle')}, direction from pa",
    "packing": "select match_id, kick_ts, kicker, receiver, packing from pa where packing is not null",
    "pass_sequence": "select match_id, generation_ts, team_id, length, first_ts, passes from chain where length >= 2",
    "double_pass": "select match_id, generation_ts, team_id, passes from chain where length = 2 and kickers[1] = receivers[2]",
    "set_play": "select * from play",
    "offside_line": """select o.match_id, o.generation_ts, o.seq, case when not nobody then o.object_id end as player_id,
        round(l.line * l.dir, 6) + 0.0 as offside_x, w.who as players_in_offside from off0 o left join off2 l on l.match_id=o.match_id and l.seq=o.seq
        left join off3 w on w.match_id=o.match_id and w.seq=o.seq""",
    "pressing_index": "select p.match_id, b.generation_ts, p.id as seq, p.player_id, round(p.pressing_index, 6) as pressing_index from pindex p join bl b on b.match_id=p.match_id and b.seq=p.id",
    "pressing_state": "select match_id, tick_ts, generation_ts, player_id, round(pressing_index, 6) as pressing_index from pstate",
    "under_pressure": "select match_id, tick_ts, generation_ts, who as player_id, round(pressing_index, 6) as pressing_index, phase, event_no from press",
    "speed_level_change": "select match_id, generation_ts, seq, object_id, team_id, cast(speed_level as bigint) as speed_level from slc",
    "dribbling_event": f"select match_id, generation_ts, seq, player_id, team_id, phase, duration, {_zero('length')}, {_zero('velocity')}, event_no from dr",
    "team_area_mbr": f"select match_id, seq, team_id, {_zero('mbr_surface')} from mbr",
    "team_area_hull": "select m.match_id, m.seq, m.team_id, round(coalesce(h.hull_surface, 0.0), 6) as hull_surface from mbr m left join hull h on h.match_id=m.match_id and h.seq=m.seq",
    "team_area_state": f"select match_id, generation_ts, seq, team_id, {_zero('mbr_surface')}, {_zero('hull_surface')} from tarea",
    "ball_possession_statistics": f"""select match_id, tick_ts, generation_ts, item, time_s, case when total = 0 then 0.0 else round(time_s / total, 6) end as percentage from (
        select t.match_id, t.tick_ts, t.max_generation_ts as generation_ts, item,
        sum(cast(coalesce(c.player_id = item or c.team_id = item, false) as int)) over (partition by t.match_id, item order by t.tick_ts)::bigint time_s,
        sum(cast(c.player_id is not null as int)) over (partition by t.match_id, item order by t.tick_ts) total
        from ({ticks('st', 'match_id', P.possession_tick_ms, P.active_threshold_ms)}) t asof left join ch c on c.match_id=t.match_id and t.tick_ts >= c.generation_ts cross join items)""",
    "pass_statistics": """select match_id, generation_ts, seq, item, successful_pass, interception, misplaced_pass, clearance,
        round(successful_pass / n, 6) as success_rate, round(fw / n, 6) as forward_rate, round(bw / n, 6) as backward_rate, round(lf / n, 6) as left_rate,
        round(rt / n, 6) as right_rate, case when successful_pass = 0 then 0.0 else round(pk / successful_pass, 6) end as avg_packing from (
        select match_id, generation_ts, seq, item, count(*) over w n, count(*) filter (where outcome = 'successful_pass') over w successful_pass,
        count(*) filter (where outcome = 'interception') over w interception, count(*) filter (where outcome = 'misplaced_pass') over w misplaced_pass,
        count(*) filter (where outcome = 'clearance') over w clearance, count(*) filter (where direction = 'FORWARD') over w fw,
        count(*) filter (where direction = 'BACKWARD') over w bw, count(*) filter (where direction = 'LEFT') over w lf,
        count(*) filter (where direction = 'RIGHT') over w rt, sum(coalesce(packing, 0)) over w pk
        from (select *, unnest([kicker, kicker_team]) as item from pa where outcome in ('successful_pass', 'interception', 'misplaced_pass', 'clearance'))
        window w as (partition by match_id, item order by generation_ts, seq))""",
    "shot_statistics": """select match_id, generation_ts, seq, item, count(*) filter (where outcome = 'goal') over w as goals, cast(0 as bigint) as on_target,
        count(*) filter (where outcome = 'shot_off_target') over w as off_target
        from (select *, unnest([kicker, kicker_team]) as item from pa where outcome in ('goal', 'shot_off_target'))
        window w as (partition by match_id, item order by generation_ts, seq)""",
    "pass_sequence_statistics": """select match_id, generation_ts, seq, item, num, round(total / num, 6) as avg_length, max_length, num_double from (
        select match_id, generation_ts, seq, item, cast(sum(first) over w as bigint) num, sum(case when first = 1 then length else 1 end) over w total,
        max(length) over w max_length, count(*) filter (where dbl) over w num_double from (
        select *, case when row_number() over (partition by match_id, item, isl order by generation_ts, seq) = 1 then 1 else 0 end as first from member)
        window w as (partition by match_id, item order by generation_ts, seq))""",
    "set_play_statistics": """select match_id, generation_ts, seq, item, """ + ", ".join(
        f"count(*) filter (where kind = '{k}') over w as {k}" for k in ("freekick", "cornerkick", "goalkick", "penalty", "throwin")
    ) + " from (select *, unnest([player_id, team_id]) as item from play) window w as (partition by match_id, item order by generation_ts, seq)",
    "speed_level_statistics": "select match_id, generation_ts, seq, item, concat_ws(';', " + ", ".join(f"t{i}//1000" for i in range(6)) + ") as times_s, "
        + ", ".join(f"round(t{i}/total, 6) as share_{i}" for i in range(6)) + " from (select *, "
        + ", ".join(f"sum(case when level = {i} then ms else 0 end) over w t{i}" for i in range(6))
        + " from sls window w as (partition by match_id, item order by seq))",
    "dribbling_statistics": """select match_id, generation_ts, seq, item, count(*) over w as num, round(avg(duration) over w / 1000, 6) as avg_duration_s,
        round(avg(length) over w, 6) as avg_length from (select *, unnest([player_id, team_id]) as item from dr where phase = 'END')
        window w as (partition by match_id, item order by seq)""",
    "distance_statistics": """select match_id, tick_ts, max_generation_ts as generation_ts, item, round(sum(d) over (partition by match_id, item order by tick_ts), 6) as distance from (
        select match_id, tick_ts, max_generation_ts, item, sum(d) d from (select *, unnest([object_id, team_id]) as item from dmove) group by all)""",
    "heatmap_cell": "select match_id, generation_ts, seq, object_id, team_id, cell_x, cell_y from hc",
    "heatmap_second": "select match_id, second, item, cell_x, cell_y, n from hs",
    "heatmap_interval": "select match_id, item, cast(interval_s as bigint) as interval_s, cell_x, cell_y, second, n from hi",
    "heatmap_rle": f"""select g.match_id, g.item, cast(g.interval_s as bigint) as interval_s, g.second, cast({P.grid_x} as bigint) as grid_x, cast({P.grid_y} as bigint) as grid_y,
        cast(coalesce(total, 0) as bigint) as total, case when t is null then '0x{P.grid_x * P.grid_y}' when last_c < {P.grid_x * P.grid_y - 1}
        then t || ';0x' || ({P.grid_x * P.grid_y - 1} - last_c) else t end as cells
        from hgrid g left join hrle r on r.match_id=g.match_id and r.item=g.item and r.interval_s=g.interval_s and r.second=g.second""",
}

phases("evphase", "select *, case when value >= 20 then case when k < 50 then 'low' else 'high' end end as ident from ev", "user_id", "generation_ts, seq")


FINALS["area_event_grid"] = FINALS["area_event"]
FINALS["latency_percentiles"] = """select match_id, max(n) as n, """ + ", ".join(
    f"min(latency_ms) filter (where upto >= {q} * n) as p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + """ from (
    select *, count(*) over (partition by match_id) n, count(*) over (partition by match_id order by latency_ms) upto
    from (select match_id, 5 + seq % 40 as latency_ms from bl)) group by match_id"""


# a stream over all files gives what the table gives
for _live in ("debounce", "deadband", "emit_on_change", "phase_events", "heatmap_second", "asof_join", "snapshot_asof", "pass_shot_match",
              "heatmap_interval"):
    FINALS[f"stream_{_live}"] = FINALS[_live]


def all_sql() -> dict[str, str]:
    return {name: sql(final) for name, final in FINALS.items()}
