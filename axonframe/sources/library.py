"""Component types that models may use without declaring them, written from the published definitions of each."""

LIBRARY = """
<neuroml>
  <ComponentType name="baseStandalone"/><ComponentType name="baseCell"/><ComponentType name="baseSpikingCell"/><ComponentType name="baseCellMembPot"/><ComponentType name="baseCellMembPotCap"/>
  <ComponentType name="baseCellMembPotDL"/><ComponentType name="baseIaf"><Parameter name="thresh" dimension="voltage"/><Parameter name="reset" dimension="voltage"/></ComponentType><ComponentType name="baseIafCapCell" extends="baseIaf"><Parameter name="C" dimension="capacitance"/></ComponentType><ComponentType name="baseSynapse"/><ComponentType name="baseVoltageDepSynapse"/>
  <ComponentType name="baseCurrentBasedSynapse"/><ComponentType name="baseSpikeSource"/><ComponentType name="basePointCurrent"/><ComponentType name="basePointCurrentDL"/><ComponentType name="baseInput"/>
  
  <ComponentType name="iafCell"><Parameter name="leakConductance" dimension="conductance"/><Parameter name="leakReversal" dimension="voltage"/>
    <Parameter name="thresh" dimension="voltage"/><Parameter name="reset" dimension="voltage"/><Parameter name="C" dimension="capacitance"/>
    <Dynamics><StateVariable name="v" dimension="voltage"/><DerivedVariable name="iSyn" select="synapses[*]/i" reduce="add"/>
      <TimeDerivative variable="v" value="(leakConductance * (leakReversal - v) + iSyn) / C"/>
      <OnStart><StateAssignment variable="v" value="leakReversal"/></OnStart>
      <OnCondition test="v .gt. thresh"><StateAssignment variable="v" value="reset"/><EventOut port="spike"/></OnCondition></Dynamics></ComponentType>
  <ComponentType name="iafRefCell" extends="iafCell"><Parameter name="refract" dimension="time"/>
    <Dynamics><StateVariable name="v" dimension="voltage"/><StateVariable name="lastSpikeTime" dimension="time"/><DerivedVariable name="iSyn" select="synapses[*]/i" reduce="add"/>
      <OnStart><StateAssignment variable="v" value="leakReversal"/></OnStart>
      <Regime name="refractory"><OnEntry><StateAssignment variable="lastSpikeTime" value="t"/><StateAssignment variable="v" value="reset"/></OnEntry>
        <OnCondition test="t .gt. lastSpikeTime + refract"><Transition regime="integrating"/></OnCondition></Regime>
      <Regime name="integrating" initial="true"><TimeDerivative variable="v" value="(leakConductance * (leakReversal - v) + iSyn) / C"/>
        <OnCondition test="v .gt. thresh"><EventOut port="spike"/><Transition regime="refractory"/></OnCondition></Regime></Dynamics></ComponentType>
  <ComponentType name="basePyNNCell"><Parameter name="cm"/><Parameter name="i_offset"/><Parameter name="tau_m"/><Parameter name="tau_refrac"/>
    <Parameter name="v_init"/><Parameter name="v_reset"/><Parameter name="v_rest"/><Parameter name="v_thresh"/><Parameter name="tau_syn_E"/><Parameter name="tau_syn_I"/>
    <Constant name="MSEC" value="1ms"/>
    <Dynamics><StateVariable name="v"/><StateVariable name="lastSpikeTime" dimension="time"/><DerivedVariable name="iSyn" select="synapses[*]/i" reduce="add"/>
      <OnStart><StateAssignment variable="v" value="v_init"/></OnStart>
      <Regime name="refractory"><OnEntry><StateAssignment variable="lastSpikeTime" value="t"/></OnEntry>
        <OnCondition test="t .gt. lastSpikeTime + tau_refrac * MSEC"><Transition regime="integrating"/></OnCondition></Regime>
      <Regime name="integrating" initial="true"><TimeDerivative variable="v" value="((i_offset + iSyn) / cm + (v_rest - v) / tau_m) / MSEC"/>
        <OnCondition test="v .gt. v_thresh"><StateAssignment variable="v" value="v_reset"/><EventOut port="spike"/><Transition regime="refractory"/></OnCondition></Regime></Dynamics></ComponentType>
  <ComponentType name="IF_curr_exp" extends="basePyNNCell"/>
  <ComponentType name="IF_curr_alpha" extends="basePyNNCell"/>
  <ComponentType name="izhikevichCell"><Parameter name="v0" dimension="voltage"/><Parameter name="thresh" dimension="voltage"/><Parameter name="a"/><Parameter name="b"/><Parameter name="c"/><Parameter name="d"/>
    <Constant name="MVOLT" value="1mV"/><Constant name="MSEC" value="1ms"/>
    <Dynamics><StateVariable name="v" dimension="voltage"/><StateVariable name="U"/><DerivedVariable name="ISyn" select="synapses[*]/I" reduce="add"/>
      <TimeDerivative variable="v" value="(0.04 * v^2 / MVOLT + 5 * v + (140.0 - U + ISyn) * MVOLT) / MSEC"/><TimeDerivative variable="U" value="a * (b * v / MVOLT - U) / MSEC"/>
      <OnStart><StateAssignment variable="v" value="v0"/><StateAssignment variable="U" value="v0 * b / MVOLT"/></OnStart>
      <OnCondition test="v .gt. thresh"><StateAssignment variable="v" value="c * MVOLT"/><StateAssignment variable="U" value="U + d"/><EventOut port="spike"/></OnCondition></Dynamics></ComponentType>
  <ComponentType name="spikeGenerator"><Parameter name="period" dimension="time"/>
    <Dynamics><StateVariable name="tnext" dimension="time"/><OnStart><StateAssignment variable="tnext" value="period"/></OnStart>
      <OnCondition test="t .geq. tnext"><StateAssignment variable="tnext" value="tnext + period"/><EventOut port="spike"/></OnCondition></Dynamics></ComponentType>
  <ComponentType name="spikeGeneratorPoisson"><Parameter name="averageRate" dimension="per_time"/>
    <Dynamics><StateVariable name="tnext" dimension="time"/><OnStart><StateAssignment variable="tnext" value="-1 * ln(random(1)) / averageRate"/></OnStart>
      <OnCondition test="t .geq. tnext"><StateAssignment variable="tnext" value="tnext - ln(random(1)) / averageRate"/><EventOut port="spike"/></OnCondition></Dynamics></ComponentType>
  <ComponentType name="alphaCurrentSynapse"><Parameter name="tau" dimension="time"/><Parameter name="ibase" dimension="current"/><Constant name="E" value="2.7182818284590451"/>
    <Exposure name="i"/><Dynamics><StateVariable name="I" dimension="current"/><StateVariable name="J" dimension="current"/><DerivedVariable name="i" exposure="i" value="I"/>
      <TimeDerivative variable="I" value="(E * J - I) / tau"/><TimeDerivative variable="J" value="-1 * J / tau"/>
      <OnEvent port="in"><StateAssignment variable="J" value="J + weight * ibase"/></OnEvent></Dynamics></ComponentType>
  <ComponentType name="expCurrSynapse"><Parameter name="tau_syn"/><Constant name="MSEC" value="1ms"/>
    <Exposure name="i"/><Dynamics><StateVariable name="I"/><DerivedVariable name="i" exposure="i" value="I"/><TimeDerivative variable="I" value="-1 * I / (tau_syn * MSEC)"/>
      <OnEvent port="in"><StateAssignment variable="I" value="I + weight"/></OnEvent></Dynamics></ComponentType>
  <ComponentType name="alphaCurrSynapse"><Parameter name="tau_syn"/><Constant name="MSEC" value="1ms"/><Constant name="E" value="2.7182818284590451"/>
    <Exposure name="i"/><Dynamics><StateVariable name="I"/><StateVariable name="A"/><DerivedVariable name="i" exposure="i" value="I"/>
      <TimeDerivative variable="I" value="(A - I) / (tau_syn * MSEC)"/><TimeDerivative variable="A" value="-1 * A / (tau_syn * MSEC)"/>
      <OnEvent port="in"><StateAssignment variable="A" value="A + E * weight"/></OnEvent></Dynamics></ComponentType>
  <ComponentType name="pulseGenerator"><Parameter name="delay" dimension="time"/><Parameter name="duration" dimension="time"/><Parameter name="amplitude" dimension="current"/>
    <Dynamics><ConditionalDerivedVariable name="i" exposure="i"><Case condition="t .geq. delay .and. t .lt. delay + duration" value="weight * amplitude"/></ConditionalDerivedVariable></Dynamics></ComponentType>
  <ComponentType name="sineGenerator"><Parameter name="phase"/><Parameter name="delay" dimension="time"/><Parameter name="duration" dimension="time"/><Parameter name="amplitude" dimension="current"/><Parameter name="period" dimension="time"/>
    <Dynamics><ConditionalDerivedVariable name="i" exposure="i"><Case condition="t .geq. delay .and. t .lt. delay + duration" value="weight * amplitude * sin(phase + 6.283185307179586 * (t - delay) / period)"/></ConditionalDerivedVariable></Dynamics></ComponentType>
  <ComponentType name="rampGenerator"><Parameter name="delay" dimension="time"/><Parameter name="duration" dimension="time"/><Parameter name="startAmplitude" dimension="current"/><Parameter name="finishAmplitude" dimension="current"/><Parameter name="baselineAmplitude" dimension="current"/>
    <Dynamics><ConditionalDerivedVariable name="i" exposure="i"><Case condition="t .geq. delay .and. t .lt. delay + duration" value="weight * (startAmplitude + (finishAmplitude - startAmplitude) * (t - delay) / duration)"/><Case value="weight * baselineAmplitude"/></ConditionalDerivedVariable></Dynamics></ComponentType>
  <ComponentType name="poissonFiringSynapse"><Parameter name="averageRate" dimension="per_time"/><Parameter name="tau" dimension="time"/><Parameter name="ibase" dimension="current"/><Constant name="E" value="2.7182818284590451"/>
    <Dynamics><StateVariable name="I" dimension="current"/><StateVariable name="J" dimension="current"/><StateVariable name="tnext" dimension="time"/><DerivedVariable name="i" exposure="i" value="weight * I"/>
      <TimeDerivative variable="I" value="(E * J - I) / tau"/><TimeDerivative variable="J" value="-1 * J / tau"/>
      <OnStart><StateAssignment variable="tnext" value="-1 * ln(1 - random(1)) / averageRate"/></OnStart>
      <OnCondition test="t .gt. tnext"><StateAssignment variable="J" value="J + ibase"/><StateAssignment variable="tnext" value="tnext - ln(1 - random(1)) / averageRate"/></OnCondition></Dynamics></ComponentType>
  <ComponentType name="spikeArray"/>
  <ComponentType name="compoundInput"><Children name="currents" type="basePointCurrent"/>
    <Dynamics><DerivedVariable name="i" exposure="i" select="currents[*]/i" reduce="add"/></Dynamics></ComponentType>
  <ComponentType name="timedSynapticInput"><ComponentReference name="synapse" type="baseSynapse"/><Children name="spikes" type="spike"/>
    <Dynamics><DerivedVariable name="i" exposure="i" select="synapse/i"/></Dynamics>
    <Structure><With instance="this" as="a"/><ChildInstance component="synapse"/><With instance="synapse" as="b"/><EventConnection from="a" to="b"/></Structure></ComponentType>
</neuroml>
"""
